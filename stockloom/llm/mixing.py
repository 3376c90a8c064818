"""Mixing sources to target weights by Pareto order sampling.

A source's target says how often a word of it is taken on average. Whole copies
are certain; what is left of that number is the share of the source's words for
which a sample of fixed size is drawn. Longer documents are likelier to be in
it: inclusion probabilities p go by the digits of the size in binary, none is
above 1, and the words expected are those wanted. Documents are ranked by
(u / (1 - u)) / (p / (1 - p)) with u a uniform hash of the id, and the lowest
ranks are taken until the source's words are reached. One closing document per
source, the one whose size comes nearest to what is missing, ends the sample
where it brings the source closer to its target.

Ranks are cut without sorting a source: words are summed by rank bucket, and
only the one bucket where the cut falls is ordered.

Inclusion odds need words by source and digits of the size only, at most 64 rows
a source.

Edge cases: a null text or one without words has size 0 and is never taken. A
null source is a source of its own, ordered last. A null id hashes as the
empty text. Repeated rows are separate documents; which of several equal rows
is taken is arbitrary, so results agree as sets of rows. An empty table gives
an empty mix. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text
from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often a source may be taken.
SHARE, CAP = 1.5, 2
#: Rank buckets of a source; a bucket holds about 1/BUCKETS of its documents.
BUCKETS = 1 << 14
#: Most sources whose targets are broadcast; beyond, a shuffled join.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(name: str = "doc_id", salt: str = "mix:") -> Column:
    """A number strictly between 0 and 1 that is a hash of the id."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), id_text(name))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def digits(size: Column) -> Column:
    """Digits of a positive number in binary: the weight of a document of that size."""
    return F.length(F.bin(size)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops
    at ``cap`` times its source's size; what is above is shared by weight among
    the others. With sources in order of cap/weight those that stop come first,
    so one pass of running sums finds the level at which the rest stand.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    run = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("all"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("full_before"),
        F.sum("weight").over(onward).alias("weight_left"),
    )
    run = run.withColumn("level", (F.col("all") - F.col("full_before")) / F.col("weight_left"))
    run = run.withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return run.select(
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("most").cast("double")).otherwise(level * F.col("weight")).alias("target"),
    )


def _with_sources(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    right = sources.withColumnRenamed("source", "__source")
    right = F.broadcast(right) if count <= BROADCAST_SOURCES else right
    return rows.join(right, rows["source"].eqNullSafe(right["__source"]), "left").drop("__source")


def inclusion(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """source, weight and chance: the inclusion probability of a source's documents of each weight.

    ``chance`` is the least of 1 and a level times the weight, so that the
    words expected are the share of the source's that whole copies leave open.
    With heavy weights first, those that stop at 1 come first.
    """
    words = sizes.where("size > 0").groupBy("source", digits(F.col("size")).alias("weight")).agg(F.sum("size").alias("words"))
    right = sources.select(F.col("source").alias("__source"), "source_size", "target")
    rows = words.join(right, F.col("source").eqNullSafe(F.col("__source")))
    expected = F.col("target") / F.col("source_size")
    rows = rows.withColumn("wanted", (expected - F.floor(expected)) * F.col("source_size"))
    order = Window.partitionBy("source").orderBy(F.desc("weight"))
    rows = rows.select(
        "*",
        F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum(F.col("weight") * F.col("words")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weighed"),
    )
    rows = rows.withColumn("level", (F.col("wanted") - F.col("full")) / F.col("weighed"))
    rows = rows.withColumn("stops", F.col("level") * F.col("weight") >= 1)
    # once a weight doesn't stop, no lighter one does
    return rows.withColumn("common", F.max(F.when(~F.col("stops"), F.struct("weight", "level"))).over(Window.partitionBy("source"))).select(
        "source", "weight", F.when(F.col("common.weight").isNull() | (F.col("weight") > F.col("common.weight")), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("common.level") * F.col("weight")))).alias("chance")
    )


def take(sizes: DataFrame, salt: str = "mix:") -> DataFrame:
    """Add source_size, target and copies to rows of row, doc_id, source and size (row: unique)."""
    sources = materialize(targets(sizes), "mix-targets")
    count = sources.count()
    chances = materialize(inclusion(sizes, sources), "mix-chances").select(F.col("source").alias("__of"), F.col("weight").alias("__weight"), "chance")
    rows = _with_sources(sizes, sources, count)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(expected)).withColumn("wanted", (expected - F.col("whole")) * F.col("source_size"))
    # at most 64 rows a source
    chances = F.broadcast(chances) if count <= BROADCAST_SOURCES // 64 else chances
    rows = rows.join(chances, F.col("source").eqNullSafe(F.col("__of")) & (F.when(F.col("size") > 0, digits(F.col("size"))) == F.col("__weight")), "left").drop("__of", "__weight")
    u = uniform(salt=salt)
    odds = F.when(F.col("chance") < 1, F.col("chance") / (1 - F.col("chance")))
    rows = rows.withColumn("rank", F.when(F.col("chance") >= 1, 0.0).when(F.col("chance") > 0, (u / (1 - u)) / odds))
    # the bucket grows with the rank, and ranks are spread over buckets much as u is
    rows = rows.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))
    drawn = rows.where(F.col("rank").isNotNull() & (F.col("size") > 0))

    summed = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = summed.withColumn("through", F.sum("words").over(run))
    cut = summed.where(F.col("through") > F.col("wanted")).groupBy("source").agg(
        F.min("bucket").alias("cut"), F.min_by(F.col("through") - F.col("words"), "bucket").alias("before"), F.first("wanted").alias("wanted")
    )
    cut = materialize(cut, "mix-cuts")

    edge = _with_sources(drawn.drop("wanted"), cut, count).where(F.col("bucket") == F.col("cut"))
    run = Window.partitionBy("source").orderBy("rank", id_text(), "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("reached", F.col("before") + F.sum("size").over(run))
    edge = edge.select("source", "row", "reached", "before", "wanted", (F.col("reached") <= F.col("wanted")).alias("in"))
    edge = materialize(edge, "mix-edge")
    missing = edge.groupBy("source").agg((F.first("wanted") - F.coalesce(F.max(F.when(F.col("in"), F.col("reached"))), F.first("before"))).alias("missing"))

    state = rows.join(edge.where("in").select("row", F.lit(True).alias("in_edge")), "row", "left")
    state = _with_sources(state, cut.select("source", "cut"), count)
    chosen = F.coalesce(F.col("in_edge"), F.lit(False)) | (F.col("rank").isNotNull() & (F.col("size") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))))
    state = state.withColumn("chosen", chosen).drop("in_edge", "cut")

    rest = _with_sources(state.where(~F.col("chosen") & F.col("rank").isNotNull() & (F.col("size") > 0)), missing, count)
    off = F.abs(F.col("size") - F.col("missing"))
    closing = rest.where(off < F.col("missing")).groupBy("source").agg(F.min_by("row", F.struct(off, "rank", id_text().alias("id"), "row")).alias("closing"))
    state = _with_sources(state, closing, count)
    extra = F.col("chosen") | F.coalesce(F.col("row") == F.col("closing"), F.lit(False))
    return state.select(
        *sizes.columns,
        F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(0).cast("long").alias("copies"),
    )


def measure(docs: DataFrame) -> DataFrame:
    """Narrow rows of a document table, each with a number of its own."""
    rows = docs.select("doc_id", "source", word_count().alias("size"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    return take(measure(docs)).withColumn("taken", F.col("size") * F.col("copies")).drop("row")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Rows are numbered and copies are joined back by number. Columns may have any
    names; while the mix works its own are kept apart from them.
    """
    names = {c: f"own{k}" for k, c in enumerate(docs.columns)}
    numbered = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("row", F.monotonically_increasing_id())
    marked = materialize(numbered, "mix-documents")
    sizes = marked.select("row", *[F.col(names[c]).alias(c) for c in ("doc_id", "source")], word_count(names["text"]).alias("size"))
    taken = take(materialize(sizes, "mix-sizes")).where("copies > 0").select("row", "copies")
    out = marked.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


#: The same rows in DuckDB.
SQL = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    [3, 1, 2][1 + (row_number() over (order by source asc nulls last) - 1) % 3] as weight
  from sizes group by source),
run as (
  select source, source_size, weight, source_size * 2 as most,
    (sum(source_size) over ())::double * 1.5::double as whole,
    coalesce(sum(source_size * 2) over (order by (source_size * 2)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as full_before,
    (sum(weight) over (order by (source_size * 2)::double / weight, source nulls last rows between current row and unbounded following))::double as weight_left
  from sources),
levels as (select *, (whole - full_before) / weight_left as level, most <= (whole - full_before) / weight_left * weight as stops from run),
targets as (
  select source, source_size, case when stops then most::double else (max(case when not stops then level end) over ()) * weight end as target
  from levels),
rows_of as (
  select row_number() over () as r, s.doc_id, s.source, s.size, t.source_size, t.target, s.u,
    case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as expected
  from sizes s join targets t on s.source is not distinct from t.source),
wholes as (
  select *, floor(expected) as whole, (expected - floor(expected)) * source_size as wanted, case when size > 0 then length(bin(size))::bigint end as weight
  from rows_of),
weights as (select source, weight, sum(size)::bigint as words, max(wanted) as wanted from wholes where size > 0 group by source, weight),
levels_of as (
  select source, weight,
    (wanted - coalesce(sum(words) over (partition by source order by weight desc rows between unbounded preceding and 1 preceding), 0)::double)
      / (sum(weight * words) over (partition by source order by weight desc rows between current row and unbounded following))::double as level
  from weights),
common as (select source, max(weight) as weight, arg_max(level, weight) as level from levels_of where not level * weight >= 1 group by source),
chances as (
  select l.source, l.weight,
    case when c.weight is null or l.weight > c.weight then 1.0::double else least(1.0::double, greatest(0.0::double, c.level * l.weight)) end as chance
  from levels_of l left join common c on l.source is not distinct from c.source),
ranked as (
  select w.*, c.chance,
    case when c.chance >= 1 then 0.0::double when c.chance > 0 then (u / (1 - u)) / (c.chance / (1 - c.chance)) end as rank
  from wholes w left join chances c on w.source is not distinct from c.source and w.weight = c.weight),
summed as (
  select *, sum(case when rank is not null then size else 0 end) over (
    partition by source order by rank nulls last, coalesce(doc_id::varchar, ''), size, r rows between unbounded preceding and current row) as reached
  from ranked),
chosen as (select *, rank is not null and size > 0 and reached <= wanted as taken_in from summed),
missing as (select source, max(wanted) - coalesce(max(case when taken_in then reached end), 0) as missing from chosen group by source),
closing as (
  select r from (
    select c.r, row_number() over (partition by c.source order by abs(c.size - m.missing), c.rank, coalesce(c.doc_id::varchar, ''), c.r) as k
    from chosen c join missing m on c.source is not distinct from m.source
    where not c.taken_in and c.rank is not null and c.size > 0 and abs(c.size - m.missing) < m.missing) where k = 1)
select doc_id, size, source_size, target,
  (case when size > 0 then size * (whole + (case when taken_in or r in (select r from closing) then 1 else 0 end)) else 0 end)::bigint as taken
from chosen
"""
