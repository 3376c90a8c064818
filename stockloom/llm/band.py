"""Numeric band join: every point with all rows whose value lies near its own.

A point p pairs with every row of another key whose value u has a gap |u - p|
of at most ``absolute``, or part/whole of the larger of the two. No pair is
formed. Three steps, all over data in order of the value:

* Totals. Counts and sums are run along the sorted values, block after block of
  a range partitioning, and the blocks' own totals are added afterwards. What a
  point pairs with is the difference between the two ends of its interval; the
  same difference along (key, value) is what belongs to its own key and is
  taken away again. Ends of intervals travel in the sorted stream themselves,
  so nothing is looked up. Sums of checksums are kept in two halves of 16 bits,
  so that they stay exact.
* Nearest pairs. Of each value the first rows are kept, at most ``nearest`` of
  a key and 2 * ``nearest`` in all, enough to find ``nearest`` rows of other
  keys whichever key is left out. One cursor runs up and one down along the
  values, each holding the nearest such rows behind it; a block's cursors start
  where the neighbouring blocks' have ended.
* Each point takes the rows of both its cursors outward, nearest first, without
  those of its own key or beyond its interval.

Values are whole numbers. Rows whose value is null pair with nothing; nor do
rows with a null key. A point with a null key has no rows of its own. Repeated
rows count each, and take a rank each; repeated points each get their result.
Ties go by gap, value, ``sale_id``, ``line_no``, key. A point without pairs, or
without a value, has one row of rank 0. Empty tables give empty results, or
points without pairs. Other columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_facts
from .store import materialize

#: Amounts from here on, infinities and what is no number have no value in cents.
MOST_AMOUNT = 1e13
#: Results of repeated points that one row becomes in one go.
COPIES = 1000
SUMS = ("n", "su", "high", "low")
#: Places of a point's stream rows: before its interval, at its value, at the interval's end; and a block's totals.
FACT, BEFORE, MIDDLE, END, TOTAL = range(5)


@dataclass(frozen=True)
class Band:
    """gap <= absolute, or whole * gap <= part * max(u, p); part is less than whole."""

    absolute: int = 100
    part: int = 1
    whole: int = 1000

    def low(self, p: Column) -> Column:
        return p - F.greatest(F.lit(self.absolute).cast("long"), _floor_div(p * self.part, self.whole))

    def high(self, p: Column) -> Column:
        return F.greatest(p + self.absolute, _floor_div(p * self.whole, self.whole - self.part))


def _floor_div(x: Column, by: int) -> Column:
    """floor(x / by) in exact whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))


def cents(amount: Column) -> Column:
    """floor(100 * amount + 0.5) in doubles."""
    amount = amount.cast("double")
    return F.when(F.abs(amount) < MOST_AMOUNT, F.floor(F.lit(100.0) * amount + F.lit(0.5)).cast("long"))


def priced(items: DataFrame) -> DataFrame:
    """Points: key and p, the price in cents."""
    return items.select(F.col("item_id").alias("key"), cents(F.col("price")).alias("p"))


def unit_prices(lines: DataFrame) -> DataFrame:
    """Rows: key, u, sale_id, line_no and crc of lines without nulls in what they are priced by.

    u is the amount in cents by quantity, rounded half up in whole numbers; a quantity of 0 gives no value.
    """
    q, sign = F.col("quantity").cast("long"), F.signum(F.col("quantity").cast("double")).cast("long")
    found = lines.select(F.col("item_id").alias("key"), "sale_id", "line_no", (sign * (2 * cents(F.col("amount")) + q)).alias("above"), (2 * sign * q).alias("below"))
    found = found.where(F.col("key").isNotNull() & F.col("sale_id").isNotNull() & F.col("above").isNotNull() & (F.col("below") > 0))
    name = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "line_no", "key")])
    return found.select("key", F.expr("(above - pmod(above, below)) div below").alias("u"), "sale_id", "line_no", F.crc32(name).alias("crc"))


# --- totals -----------------------------------------------------------------

def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order: those of points, with the sums over all rows of the block up to them; then the block's totals."""
    carried = np.zeros(len(SUMS), np.int64)
    block, names, kinds = TaskContext.get().partitionId(), None, None
    for batch in batches:
        names, kinds = batch.schema.names, batch.schema.types
        values = np.stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in SUMS])
        sums = np.cumsum(values, axis=1) + carried[:, None]
        carried = sums[:, -1].copy() if batch.num_rows else carried
        wanted = np.flatnonzero(batch.column(names.index("role")).to_numpy(zero_copy_only=False) != FACT)
        if len(wanted):
            part = batch.take(pa.array(wanted))
            columns = [pa.array(sums[SUMS.index(c)][wanted]) if c in SUMS else pa.array(np.full(len(wanted), block, np.int32)) if c == "block" else part.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)
    if names is not None:
        told = dict(zip(SUMS, carried.tolist(), strict=True)) | {"role": TOTAL, "block": block}
        yield pa.RecordBatch.from_arrays([pa.array([told.get(c)], kind) for c, kind in zip(names, kinds, strict=True)], names)


def _totals(points: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of points (key, p, copies, low, high): totals over the rows of their own key, and of each p over all rows.

    Hot keys and hot values are one row for each (key, value) before any are
    sorted, and the sorted stream is cut anywhere, so no key meets in one task.
    """
    zero = F.lit(0).cast("long")
    facts = materialize(
        rows.groupBy("key", "u").agg(F.count("*").alias("n"), F.sum(F.shiftright("crc", 16)).alias("high"), F.sum(F.col("crc").bitwiseAND(F.lit(65535).cast("long"))).alias("low")), "band-facts"
    )
    every = facts.groupBy("u").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    kind = points.schema["key"].dataType
    no_key = F.lit(None).cast(kind)

    def of_rows(found: DataFrame, own: bool) -> DataFrame:
        return found.select(
            F.lit(own).alias("own"), (F.col("key").cast(kind) if own else no_key).alias("key"), F.col("u").alias("value"), F.lit(FACT).alias("role"),
            zero.alias("p"), zero.alias("copies"), F.lit(0).alias("block"), "n", (F.col("n") * F.col("u")).alias("su"), "high", "low",
        )

    def of_points(found: DataFrame, own: bool) -> DataFrame:
        ends = F.array(*[F.struct(value.alias("value"), F.lit(role).alias("role")) for value, role in ((F.col("low") - 1, BEFORE), (F.col("p"), MIDDLE), (F.col("high"), END))])
        found = found.select((F.col("key") if own else no_key).alias("key"), "p", "copies", F.explode(ends).alias("end"))
        return found.select(F.lit(own).alias("own"), "key", "end.value", "end.role", "p", "copies", F.lit(0).alias("block"), *[zero.alias(c) for c in SUMS])

    prices = points.groupBy("p").agg(F.count("*").alias("copies"), F.first("low").alias("low"), F.first("high").alias("high"))
    stream = of_rows(facts, True).unionByName(of_rows(every, False)).unionByName(of_points(points, True)).unionByName(of_points(prices, False))
    order = ["own", "key", "value", "role"]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stream.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInArrow(_running, ", ".join(f"{c} {kind}" for c, kind in stream.dtypes)), "band-sums")
    # one row a block, and as many blocks as shuffle partitions
    blocks = found.where(F.col("role") == TOTAL).select("block", *SUMS)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(before), zero).alias(f"{c}_before") for c in SUMS])
    placed = found.where(F.col("role") != TOTAL).join(F.broadcast(blocks), "block")
    n, su, high, low = (F.col(c) + F.col(f"{c}_before") for c in SUMS)
    side = F.col("role") - MIDDLE  # -1 before the interval, 0, and 1 at its end
    both = F.when(F.col("role") == MIDDLE, -2).otherwise(1)
    # the sum of u - p above p and p - u below: an end's sums once each, those at p twice with the other sign
    sums = [F.sum(side * n).alias("n_pairs"), F.sum(both * (su - F.col("p") * n)).alias("gap_sum"), F.sum(side * high).alias("high"), F.sum(side * low).alias("low")]
    copies = F.sum(F.when(F.col("role") == MIDDLE, F.col("copies"))).alias("copies")
    return placed.where("own").groupBy("key", "p").agg(copies, *sums), placed.where("not own").groupBy("p").agg(copies.alias("points"), *[s.alias(f"all_{c}") for s, c in zip(sums, ("n_pairs", "gap_sum", "high", "low"), strict=True)])


# --- nearest rows -----------------------------------------------------------

def merged(front: list, back: list, nearest: int) -> list:
    """The first rows (value, sale, line, key) of two lists one after the other: at most ``nearest`` of a key, 2 * ``nearest`` in all."""
    out, held = [], {}
    for row in (*front, *back):
        held[row[3]] = held.get(row[3], 0) + 1
        if held[row[3]] <= nearest:
            out.append(row)
            if len(out) == 2 * nearest:
                break
    return out


FIELDS = ("value", "sale_id", "line_no", "key")


def _lists(schema: pa.Schema):
    """Arrow lists of rows, whose ids have the types of ``schema``."""
    kind = pa.list_(pa.struct([(f, schema.field(f).type) for f in FIELDS]))
    return lambda lists: pa.array([[dict(zip(FIELDS, row, strict=True)) for row in rows] for rows in lists], kind)


def _cursors(nearest: int):
    """A task that moves a cursor up and one down along a block's values, and tells at each point what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # of a value 2 * nearest rows and a point at most
        if not batches:
            return
        block = pa.Table.from_batches(batches)
        told = _lists(block.schema)
        values, point = block.column("value").to_pylist(), block.column("role").to_pylist()
        rows = list(zip(*[block.column(f).to_pylist() for f in FIELDS], strict=True))
        starts = [k for k in range(len(values)) if k == 0 or values[k] != values[k - 1]] + [len(values)]
        groups = [(values[a], [rows[k] for k in range(a, b) if not point[k]], any(point[a:b])) for a, b in zip(starts, starts[1:], strict=False)]
        below, above, down, up = {}, {}, [], []
        for value, own, is_point in groups:
            if is_point:
                below[value] = down
            down = merged(own, down, nearest)
        for value, own, is_point in reversed(groups):
            up = merged(own, up, nearest)
            if is_point:
                above[value] = up
        number = pa.array(np.full(len(below) + 1, TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([None, *below], pa.int64()), number, told([down, *below.values()]), told([up, *[above[v] for v in below]])], ["p", "block", "below", "above"])

    return run


def _carried(nearest: int):
    """A task over one row a block: what a block's cursors hold that come from the blocks on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        ends = pa.Table.from_batches(batches).sort_by("block")
        kind = ends.schema.field("below").type
        told = _lists(pa.schema([kind.value_type.field(f) for f in FIELDS]))
        plain = lambda side: [[tuple(x[f] for f in FIELDS) for x in rows] for rows in ends.column(side).to_pylist()]
        from_below, from_above, down, up = [], [], [], []
        for own in plain("below"):
            from_below.append(down)
            down = merged(own, down, nearest)
        for own in reversed(plain("above")):
            from_above.append(up)
            up = merged(own, up, nearest)
        yield pa.RecordBatch.from_arrays([ends.column("block").combine_chunks(), told(from_below), told(from_above[::-1])], ["block", "from_below", "from_above"])

    return run


def _nearest(points: DataFrame, rows: DataFrame, nearest: int) -> DataFrame:
    """p, below and above: for each value of a point the nearest rows under it, and those at it or over it, nearest first.

    Both rankings keep only the first rows of a group already before they
    shuffle, so a value or key with a third of all rows sends a few of each task.
    """
    of_key = Window.partitionBy("u", "key").orderBy("sale_id", "line_no")
    of_value = Window.partitionBy("u").orderBy("sale_id", "line_no", "key")
    some = rows.select("u", "key", "sale_id", "line_no").withColumn("at", F.row_number().over(of_key)).where(F.col("at") <= nearest)
    some = some.withColumn("at", F.row_number().over(of_value)).where(F.col("at") <= 2 * nearest)
    kinds = {f: "bigint" if f == "value" else rows.schema[f].dataType.simpleString() for f in FIELDS}
    prices = points.select("p").distinct().select(F.col("p").alias("value"), F.lit(1).alias("role"), *[F.lit(None).cast(kinds[f]).alias(f) for f in FIELDS[1:]])
    stream = some.select(F.col("u").alias("value"), F.lit(0).alias("role"), *FIELDS[1:]).unionByName(prices)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stream.repartitionByRange(parts, "value").sortWithinPartitions("value", "role", *FIELDS[1:])
    near = f"array<struct<{', '.join(f'{f}: {kind}' for f, kind in kinds.items())}>>"
    found = materialize(ordered.mapInArrow(_cursors(nearest), f"p bigint, block int, below {near}, above {near}"), "band-cursors")
    # at most 4 * nearest rows for each of as many blocks as shuffle partitions
    ends = found.where("p is null").select("block", "below", "above").repartition(1)
    ends = ends.mapInArrow(_carried(nearest), f"block int, from_below {near}, from_above {near}")
    out = found.where("p is not null").join(F.broadcast(ends), "block")
    return out.select("p", F.concat("below", "from_below").alias("below"), F.concat("above", "from_above").alias("above"))


# --- the join ---------------------------------------------------------------

def band_join(points: DataFrame, rows: DataFrame, nearest: int = 2, band: Band = Band()) -> DataFrame:  # noqa: B008
    """key, p, rank, gap, u, sale_id, line_no, row_key, n_pairs, gap_sum and checksum of every point (key, p) among ``rows`` (key, u, sale_id, line_no, crc).

    n_pairs, gap_sum and checksum (the sum of crc) are over all pairs; a point
    has a row for each of its first ``nearest`` ones. A sum beyond 64 bits is an
    error, not a wrong number.
    """
    known = points.where("p is not null").groupBy("key", "p").agg(F.count("*").alias("copies"))
    known = materialize(known.select("*", band.low(F.col("p")).alias("low"), band.high(F.col("p")).alias("high")), "band-points")
    own, every = _totals(known, rows)
    every = materialize(every.join(_nearest(known, rows, nearest), "p"), "band-prices")
    total, most = known.agg(F.count("*"), F.max("copies")).first()
    found = join_facts(own, every, "p", "points", total, F.xxhash64("key"))
    low, high, p = band.low(F.col("p")), band.high(F.col("p")), F.col("p")
    pair = lambda x: F.struct(F.abs(x["value"] - p).alias("gap"), x["value"].alias("u"), x["sale_id"].alias("sale_id"), x["line_no"].alias("line_no"), x["key"].alias("row_key"))
    other = lambda x: (x["value"] >= low) & (x["value"] <= high) & ~x["key"].eqNullSafe(F.col("key"))
    pairs = F.slice(F.array_sort(F.transform(F.filter(F.concat("below", "above"), other), pair)), 1, nearest)
    found = found.select(
        "key", "p", "copies", pairs.alias("pairs"),
        *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("n_pairs", "gap_sum")],
        ((F.col("all_high") - F.col("high")) * 65536 + F.col("all_low") - F.col("low")).alias("checksum"),
    )
    chunks = F.call_function("div", F.col("copies") - 1, F.lit(COPIES).cast("long"))
    found = found.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks)))
    if (most or 0) > COPIES:
        found = found.repartition("key", "p", "chunk")
    found = found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("chunk") * COPIES).cast("int"))))
    found = found.select("key", "p", F.posexplode_outer("pairs").alias("at", "pair"), "n_pairs", "gap_sum", "checksum")
    found = found.select("key", "p", F.coalesce(F.col("at") + 1, F.lit(0)).alias("rank"), "pair.*", "n_pairs", "gap_sum", "checksum")
    kinds = dict(found.dtypes)
    absent = points.where("p is null").select("key", "p", F.lit(0).alias("rank"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("gap", "u", "sale_id", "line_no", "row_key")], *[F.lit(0).cast("long").alias(c) for c in ("n_pairs", "gap_sum", "checksum")])
    return found.unionByName(absent)


#: The same rows in DuckDB. The checksum's table of 256 entries is worked out from its polynomial.
SQL = r"""
with steps as (select list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)::bigint as entry, i from range(256) t(i)),
crc_table as (select list(entry order by i) as entries from steps),
points as (select item_id, floor(100 * price::double + 0.5)::bigint as p from items),
cents as (
  select item_id as line_item_id, sale_id, line_no, sign(quantity) * (2 * floor(100 * amount::double + 0.5)::bigint + quantity) as above, 2 * abs(quantity)::bigint as below,
    sale_id || ',' || coalesce(line_no::varchar, '') || ',' || item_id as name
  from sale_lines where sale_id is not null and item_id is not null and quantity <> 0 and amount is not null),
valued as (
  select line_item_id, sale_id, line_no, (above - ((above % below) + below) % below) // below as u,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda ch: ascii(ch)::bigint)),
      lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1])), 4294967295) as crc
  from cents, crc_table),
numbered as (select *, row_number() over () as no from points),
bounds as (select *, least(p - 100, p - p // 1000) as low, greatest(p + 100, 1000 * p // 999) as high from numbered where p is not null),
pairs as (
  select b.no, abs(v.u - b.p) as gap, v.*
  from bounds b join valued v on v.u >= b.low and v.u <= b.high where v.line_item_id is distinct from b.item_id and (abs(v.u - b.p) <= 100 or 1000 * abs(v.u - b.p) <= greatest(v.u, b.p))),
ranked as (select *, row_number() over (partition by no order by gap, u, sale_id, line_no nulls first, line_item_id) as rank from pairs),
totals as (select no, count(*) as n_pairs, sum(gap)::bigint as gap_sum, sum(crc)::bigint as lines_crc from pairs group by no)
select n.item_id, coalesce(r.rank, 0)::int as rank, r.gap::bigint as gap, r.u::bigint as u, r.sale_id::bigint as sale_id, r.line_no::bigint as line_no, r.line_item_id::bigint as line_item_id,
  coalesce(t.n_pairs, 0) as n_pairs, coalesce(t.gap_sum, 0) as gap_sum, coalesce(t.lines_crc, 0) as lines_crc
from numbered n left join totals t using (no) left join (select * from ranked where rank <= 2) r using (no)
"""
