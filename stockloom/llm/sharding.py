"""Shards by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards, each shard with a weight; a node weighs
what is under it. A row goes down from the root: at each node every child makes
a draw from the hash of row key and child, -ln(u) / weight, and the least wins,
so children get rows by their weights. A child's draw depends on nothing but
the key, itself and its weight. So where one child's weight changes, rows move
only to it or away from it, and below a node whose weight stays none move
unless weights below it change; what moves stays in the subtrees that changed.

``grown`` adds a shard as a region of its own: no other weight changes, and rows
move to the new shard alone. The law is ``key``: a row's key and the tree decide
its shard, whatever else there is.

Draws are 52 bits of md5 of ``key:node``; DuckDB makes the same ones. Slots
number a shard's rows by key, checksum and size without gaps. Rows are numbered
in ranges of that order, which are cut anywhere, and the ranges' counts are
added up, so neither a shard nor a hot key is one task.

Edge cases: a null key is the empty text, and its rows share one shard, as do
rows of one key; equal rows have slots of their own. A null text has no bytes.
Nodes of weight 0 get nothing; a tree without weight is an error. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text
from .store import materialize

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
SHARDS, RACKS_OF_REGION, SHARDS_OF_RACK = 40, 2, 4


@dataclass(frozen=True)
class Tree:
    """Weights of shards, as regions of racks of (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def __post_init__(self):
        shards = [shard for region in self.regions for rack in region for shard, _ in rack]
        if len(set(shards)) < len(shards) or not self.weight() > 0:
            raise ValueError("shards of a tree must differ, and one must have weight")

    def weight(self) -> float:
        return sum(w for region in self.regions for rack in region for _, w in rack)

    def grown(self, shard: int, weight: float = 1.0) -> Tree:
        """This tree with one more shard, a region of its own."""
        return Tree((*self.regions, (((shard, weight),),)))


def even(shards: int = SHARDS) -> Tree:
    """A tree of shards 0 to ``shards`` - 1 of equal weight, filled rack by rack."""
    racks = [tuple((s, 1.0) for s in range(r, min(shards, r + SHARDS_OF_RACK))) for r in range(0, shards, SHARDS_OF_RACK)]
    return Tree(tuple(tuple(racks[r : r + RACKS_OF_REGION]) for r in range(0, len(racks), RACKS_OF_REGION)))


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight, u from 52 bits of md5 and never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node}")).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _least(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """Number of the child (number, name, weight) that wins; null if none has weight."""
    draws = [F.struct(_draw(key, name, weight).alias("draw"), F.lit(number).alias("number")) for number, name, weight in children if weight > 0]
    if not draws:
        return F.lit(None).cast("int")
    return (F.least(*draws) if len(draws) > 1 else draws[0])["number"]


def _switch(on: Column, cases: list[Column]) -> Column:
    """The case whose number ``on`` is; only that one is worked out."""
    out = None
    for number, case in enumerate(cases):
        out = F.when(on == number, case) if out is None else out.when(on == number, case)
    return out


def placed(rows: DataFrame, tree: Tree, key: Column, name: str = "shard") -> DataFrame:
    """``rows`` with ``name`` (region, rack, shard), where the tree sends each; racks are numbered within their region."""
    rack_weight = lambda rack: sum(w for _, w in rack)
    regions = [(i, f"region {i}", sum(map(rack_weight, region))) for i, region in enumerate(tree.regions)]
    racks = [[(j, f"rack {i}.{j}", rack_weight(rack)) for j, rack in enumerate(region)] for i, region in enumerate(tree.regions)]
    shards = [[[(s, f"shard {s}", w) for s, w in rack] for rack in region] for region in tree.regions]
    out = rows.withColumn("__region", _least(key, regions))
    out = out.withColumn("__rack", _switch(F.col("__region"), [_least(key, r) for r in racks]))
    leaf = _switch(F.col("__region"), [_switch(F.col("__rack"), [_least(key, s) for s in region]) for region in shards])
    place = F.struct(F.col("__region").alias("region"), F.col("__rack").alias("rack"), leaf.alias("shard"))
    return out.withColumn(name, place).drop("__region", "__rack")


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, their number from 0 in their shard by ``order``."""
    named = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the row's own number cuts also between equal rows
    ranged = named.repartitionByRange(parts, "shard", *order, "row").withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "shard-ranges")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range", "shard").agg(F.count("*").alias("n"))
    # at most one row for each range and each shard that begins in it
    counts = counts.select("range", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range", "shard").orderBy(*order, "row"))
    out = ranged.withColumn("within", within).join(F.broadcast(counts), ["range", "shard"])
    return out.withColumn("slot", F.col("before") + F.col("within") - 1).drop("row", "range", "before", "within")


def shard(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region and rack of every document.

    grown_shard is where it goes in a tree with one more shard.
    """
    tree = tree or even()
    more = 1 + max(s for region in tree.regions for rack in region for s, _ in rack)
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), id_text().alias("key"))
    rows = placed(placed(rows, tree, F.col("key"), "now"), tree.grown(more), F.col("key"), "then")
    rows = rows.select("doc_id", "size", "text_crc32", F.col("now.shard").alias("shard"), F.col("then.shard").alias("grown_shard"), F.col("now.region").alias("region"), F.col("now.rack").alias("rack"))
    out = slots(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


#: The same rows in DuckDB. The checksum's table of 256 entries is worked out from its polynomial, a text's from its bytes in hexadecimal.
SQL = r"""
with keyed as (select row_number() over () as no, doc_id, coalesce(doc_id::varchar, '') as key, coalesce(text, '') as text from documents),
shards as (select s, s // 4 as rack, s // 8 as region from range(41) t(s)),
trees as (select n, s, rack, region from shards, (values (40), (41)) v(n) where s < n),
nodes as (
  select n, 'region' as level, -1 as parent, region as node, 'region ' || region as name, count(*) as weight from trees group by all
  union all select n, 'rack', region, rack, 'rack ' || region || '.' || (rack - 2 * region), count(*) from trees group by all
  union all select n, 'shard', rack, s, 'shard ' || s, 1 from trees),
draws as (
  select k.no, n, level, parent, node, -ln((('0x' || substr(md5(k.key || ':' || name), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double) / weight::double as draw
  from keyed k, nodes),
first as (select no, n, arg_min(node, draw) as region from draws where level = 'region' group by no, n),
second as (select f.no, f.n, f.region, arg_min(d.node, d.draw) as rack from first f join draws d on d.no = f.no and d.n = f.n and d.level = 'rack' and d.parent = f.region group by all),
third as (select f.no, f.n, f.region, f.rack, arg_min(d.node, d.draw) as shard from second f join draws d on d.no = f.no and d.n = f.n and d.level = 'shard' and d.parent = f.rack group by all),
steps as (select list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)::bigint as entry, i from range(256) t(i)),
crc_table as (select list(entry order by i) as entries from steps),
summed as (
  select no, doc_id, strlen(text) + 16 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(text), '..'), lambda b: ('0x' || b)::bigint)),
      lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1])), 4294967295) as text_crc32
  from keyed, crc_table)
select s.doc_id, s.size::bigint as size, s.text_crc32, 'key' as law, a.shard::int as shard,
  row_number() over (partition by a.shard order by s.doc_id nulls first, s.text_crc32, s.size) - 1 as slot, b.shard::int as grown_shard, a.region::int as region, (a.rack - 2 * a.region)::int as rack
from summed s join third a on a.no = s.no and a.n = 40 join third b on b.no = s.no and b.n = 41
"""
