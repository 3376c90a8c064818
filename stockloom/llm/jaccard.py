"""Join of documents on the Jaccard similarity of their word shingles.

Texts with the same set of shingles are one class, and only classes are
compared. Classes that agree on a band of MinHash values share a bucket; of
buckets with the same members one is kept. Within a bucket pairs are compared
MinHash value by value, and a pair is dropped as soon as the posterior
probability that it reaches the threshold falls below TOLERANCE, or at once
where the sizes of the two sets rule it out. What is left
links classes to clusters, within which every surviving pair is verified on
the shingles themselves.

Pairs are never rows: buckets and clusters are cut into blocks, a task
compares two blocks in memory, and gives for each class its number of links
and one edge to its component. So a group of n near copies costs n rows a
block, and its work is split over as many tasks as it has pairs of blocks.
Blocks of a large group hold more classes, as the square root of its size, as
far as their texts stay within BLOCK_BYTES. A key that very many rows share is
never gathered in a join: what is known of it is broadcast.

Edge cases: a null text, an empty one or one without words has no shingle, no
link and a class of its own; a text of fewer than SIZE words has one shingle.
Equal texts are links of each other. Repeated rows are separate documents. A
class is named after its least doc_id; a null id counts as less than any other.
An empty table gives an empty result.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import join_facts
from .store import materialize
from .text import NOT_SPACE, buffers, mix, shingles, slices, words

SIZE, THRESHOLD = 5, 0.8
#: MinHash values of a class; BANDS bands of ROWS of them make buckets; compared STEP at a time.
VALUES, BANDS, ROWS, STEP = 128, 25, 4, 32
TOLERANCE = 1e-9
#: Classes of a block in groups of up to BLOCK_OF of them, and most bytes of a block's texts, the longest text aside.
BLOCK, BLOCK_OF, BLOCK_BYTES = 512, 16_384, 16 << 20

_r = np.random.default_rng(20240229)
_FACTORS = (_r.integers(1, 1 << 63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_TERMS = _r.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def least_matches(seen: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest agreeing values of ``seen`` with which P(similarity >= threshold) is at least ``tolerance``, from an even prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    logs = np.log(grid), np.log1p(-grid)
    for m in range(seen + 1):
        density = m * logs[0] + (seen - m) * logs[1]
        density = np.exp(density - density.max())
        if density[grid >= threshold].sum() >= tolerance * density.sum():
            return m
    return seen


_LEAST = [least_matches(n) for n in range(STEP, VALUES + 1, STEP)]


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values [documents, VALUES] of documents' shingles; of a document without any, the largest value."""
    out = np.full((len(first) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        starts = first[:-1][some]
        hashed = np.empty(len(values), np.uint64)
        for k in range(VALUES):
            np.multiply(values, _FACTORS[k], out=hashed)
            hashed += _TERMS[k]
            out[some, k] = (np.minimum.reduceat(hashed, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches):
        values, first = shingles(words(data, offsets, NOT_SPACE, lower=False), SIZE)
        sizes = np.diff(first)
        some = np.flatnonzero(sizes)
        name = np.zeros((len(sizes), 2), np.uint64)
        if len(some):
            name[some, 0] = np.add.reduceat(mix(values), first[:-1][some])
            name[some, 1] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][some])
        kept = pa.array(sizes > 0)
        names = pa.array([x.tobytes() for x in name], pa.binary())
        sketches = pa.array([x.tobytes() for x in signatures(values, first)], pa.binary())
        columns = [part.column(0), part.column(1), names, sketches, pa.array(sizes.astype(np.int64)), pa.array(np.diff(offsets))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "name", "sketch", "size", "bytes"]).filter(kept)


def surviving(a: np.ndarray, b: np.ndarray | None, sizes_a: np.ndarray, sizes_b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures, within ``a`` or between ``a`` and ``b``, that neither sizes nor comparing value by value drops."""
    left, right = [], []
    for k in range(len(a)):
        other, size, shift = (a[k + 1 :], sizes_a[k + 1 :], k + 1) if b is None else (b, sizes_b, 0)
        # sets can only be 4 / 5 alike if the smaller one has 4 / 5 of the larger one's members
        alive = np.flatnonzero((5 * np.minimum(size, sizes_a[k]) >= 4 * np.maximum(size, sizes_a[k])))
        matches = np.zeros(len(alive), np.int64)
        for at, least in enumerate(_LEAST):
            if not len(alive):
                break
            cut = slice(at * STEP, (at + 1) * STEP)
            matches = matches + (other[alive, cut] == a[k, cut]).sum(axis=1)
            keep = matches >= least
            alive, matches = alive[keep], matches[keep]
        if len(alive):
            left.append(np.full(len(alive), k))
            right.append(alive + shift)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(left) < 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1  # shingles of a single set are in no intersection
    use = counts[inverse] > 1
    doc, at = doc[use], column[inverse[use]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at.max(initial=-1)) + 1, 4096):
        here = (at >= low) & (at < low + 4096)
        table = np.zeros((len(sets), 4096), np.float32)
        table[doc[here], at[here] - low] = 1
        total += table @ table.T
    return total[left, right].astype(np.int64)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree on the first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        changed = np.zeros(len(batch), bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), len(batch)]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[lo] for c in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of both blocks of a task; None for the second where it compares one block within itself."""
    if table["i"][0].as_py() == table["j"][0].as_py():
        return np.arange(len(table)), None
    first = np.asarray(table["c"].combine_chunks()) == table["i"][0].as_py()
    return np.flatnonzero(first), np.flatnonzero(~first)


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sketches = _matrix(table["sketch"])
    a, b = _sides(table)
    sizes = np.asarray(table["size"].combine_chunks())
    left, right = surviving(sketches[a], None if b is None else sketches[b], sizes[a], None if b is None else sizes[b])
    return a[left], (a if b is None else b)[right]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, 3):
        left, right = _pairs(table)
        if not len(left):
            continue
        root = _roots(len(table), left, right)
        node = np.asarray(table["class"].combine_chunks())
        hangs = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(node[hangs]), pa.array(node[root[hangs]])], ["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, 3):
        left, right = _pairs(table)
        node = np.asarray(table["class"].combine_chunks())
        copies = np.asarray(table["copies"].combine_chunks())
        data, offsets = buffers(table["text"])
        values, first = shingles(words(data, offsets, NOT_SPACE, lower=False), SIZE)
        sets = [values[first[k] : first[k + 1]] for k in range(len(table))]
        sizes = np.diff(first)
        both = overlaps(sets, left, right)
        # both / (a + b - both) >= 4 / 5
        linked = 9 * both >= 4 * (sizes[left] + sizes[right])
        left, right = left[linked], right[linked]
        links = np.zeros(len(table), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        root = _roots(len(table), left, right)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], ["class", "links", "root"])


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows with key, members and bytes, dealt to tasks (key, i, j) that compare blocks i and j of a key's members."""
    many = F.col("members") / (BLOCK * F.greatest(F.lit(1.0), F.sqrt(F.col("members") / BLOCK_OF)))
    blocks = F.ceil(F.greatest(many, F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("c", F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o")).drop("o", "blocks", "members", "bytes")
    first = [key, "i", "j", "c"]
    rows = rows.select(*first, *[c for c in rows.columns if c not in first])
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _classes(sketched: DataFrame) -> DataFrame:
    found = sketched.groupBy("name").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.min("sketch").alias("sketch"), F.min("size").alias("size"), F.max("bytes").alias("bytes"))
    return materialize(found.withColumn("class", F.monotonically_increasing_id()), "jaccard-classes")


def _buckets(classes: DataFrame, count: int) -> DataFrame:
    """bucket, class, sketch, size and members of buckets with several classes; of buckets with equal members only one."""
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", b * ROWS * 4 + 1, ROWS * 4)) for b in range(BANDS)])
    keys = classes.select("class", F.explode(bands).alias("bucket"))
    found = keys.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"))
    found = found.where("members > 1").groupBy("members", "x", "y").agg(F.min("bucket").alias("bucket"))
    found = materialize(found.select("bucket", "members", F.col("members").alias("uses")), "jaccard-buckets")
    shared = join_facts(keys, found, "bucket", "uses", BANDS * count, F.xxhash64("class")).where("members is not null")
    # signatures are as long as each other, so blocks go by members alone
    return shared.join(classes.select("class", "sketch", "size"), "class").withColumn("bytes", F.lit(0))


def join(marked: DataFrame) -> DataFrame:
    """row, doc_id, class_id, n_links and first of documents with a unique ``row``.

    class_id is the least doc_id of all documents that links connect; n_links
    counts the other documents within the threshold, copies among them; first
    holds for one document of every class.
    """
    kind = marked.schema["doc_id"].dataType.simpleString()
    texts = marked.select("row", "doc_id", F.col("text").cast("string").alias("text"))
    sketched = materialize(texts.mapInArrow(_sketch, f"row long, doc_id {kind}, name binary, sketch binary, size long, bytes long"), "jaccard-sketches")
    documents = sketched.count()
    classes = _classes(sketched)
    count = classes.count()
    edges = _in_blocks(_buckets(classes, count), "bucket").mapInArrow(_link, "u long, v long")
    clusters = graph.components(edges).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    clusters = materialize(clusters.join(classes.select("class", "row", "copies", "sketch", "size", "bytes"), "class"), "jaccard-clusters")
    groups = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("bytes").alias("all_bytes"), F.count("*").alias("uses"))
    needed = join_facts(clusters.drop("bytes"), groups, "cluster", "uses", count, F.xxhash64("class")).withColumnRenamed("all_bytes", "bytes")
    # whole texts of one document of each clustered class
    held = needed.join(texts.select("row", "text"), "row").drop("row")
    checked = _in_blocks(held, "cluster").mapInArrow(_verify, "class long, links long, root long")
    checked = materialize(checked, "jaccard-links")
    links = checked.groupBy("class").agg(F.sum("links").alias("links"))
    roots = graph.components(checked.select(F.col("class").alias("u"), F.col("root").alias("v")))
    facts = classes.select("name", "class", "copies").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    facts = facts.select("name", "copies", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    facts = materialize(facts, "jaccard-facts")
    found = join_facts(sketched.select("row", "doc_id", "name"), facts, "name", "copies", documents, F.xxhash64("row"))
    found = materialize(found.drop("name"), "jaccard-documents")
    least = found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("uses"))
    found = join_facts(found, least, "root", "uses", documents, F.xxhash64("row")).select("row", F.col("least.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("least.row")).alias("first"))
    out = texts.select("row", "doc_id").join(found, "row", "left")
    alone = F.col("n_links").isNull()
    return out.select(
        "row", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("first", F.lit(True)).alias("first"),
    )


def mark(docs: DataFrame) -> DataFrame:
    """Documents with a unique ``row`` that stays the same when they are read again."""
    return materialize(docs.withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    return join(mark(docs.select("doc_id", "text"))).select("doc_id", "class_id", "n_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of every class, the one of least id, with all its columns."""
    columns = docs.columns
    kept = [c if c.lower() != "row" else "__row" for c in columns]
    marked = mark(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, kept, strict=True)]))
    chosen = join(marked).where("first").select("row")
    return marked.join(chosen, "row", "left_semi").select(*[F.col(f"`{k}`").alias(c) for c, k in zip(columns, kept, strict=True)])
