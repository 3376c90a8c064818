"""Token ids of documents in a content-addressed store.

``write`` encodes texts, cuts each id stream where a rolling hash of its last
ids says so, stores every distinct chunk once under its hash, and writes for
each document, in ascending order of ids, a recipe: the hashes of its chunks
and a Merkle root over them. Recipes lie in parts; a manifest has each part's
root over its recipes and the number of ids before it. ``read`` checks every
chunk against its hash, every recipe against its root and its number of ids,
every part against the manifest, and gives the ids back.

Layout of a store: ``chunks`` (hash, n_ids, ids: little-endian unsigned 32-bit
integers, or 16-bit where all fit; the first byte is the width in bytes; uses:
how often recipes name it), ``recipes`` (part, place, doc_id, start, n_tokens,
root, chunks) and ``manifest`` (part, start, n_documents, n_tokens, root,
id_type), all Parquet. Ids of documents are of any type that can be ordered.

Edge cases: a null or empty text is the end id alone. Null ids come first.
Documents of equal id are ordered by their roots; equal rows are stored twice
as recipes and once as chunks. An empty table gives an empty store. Text that
looks like one of the tokenizer's special tokens is encoded as the tokenizer
does by default.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_facts
from .store import drop, materialize, new_path
from .text import mix, slices, span_hashes

END = 2
#: Ids that the rolling hash sees, the mean distance of cuts (a power of two), and a chunk's least and most ids.
SEEN, MEAN, LEAST, MOST = 8, 512, 128, 4096
#: Bytes that a worker remembers of units, their ids and their places before it starts afresh, and the longest unit that it remembers.
REMEMBERED_BYTES, LONGEST_UNIT = 64 << 20, 256
#: Bytes of a unit's hash, length and places.
UNIT_BYTES = 40
#: Units of one text that goes to the tokenizer; it is fastest on short ones.
JOINED = 100
ROWS_OF_PART = 20_000


_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: Other white space in UTF-8: first two bytes, and the lowest and highest third byte (None: there is no third).
_WIDE_SPACE = ((0xC2, 0x85, None), (0xC2, 0xA0, None), (0xE1, 0x9A, (0x80, 0x80)), (0xE2, 0x80, (0x80, 0x8A)), (0xE2, 0x80, (0xA8, 0xA9)), (0xE2, 0x80, (0xAF, 0xAF)), (0xE2, 0x81, (0x9F, 0x9F)), (0xE3, 0x80, (0x80, 0x80)))


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _ASCII_SPACE[data]
    for one, two, third in _WIDE_SPACE:
        at = np.flatnonzero(data[:-1] == one)
        at = at[data[at + 1] == two]
        if third and len(at):
            at = at[at + 2 < len(data)]
            at = at[(data[at + 2] >= third[0]) & (data[at + 2] <= third[1])]
        for k in range(3 if third else 2):
            out[at + k] = True
    return out


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer, each distinct unit of text encoded once.

    The tokenizer's rules always cut before a single space between two other
    characters, so what lies between such spaces are units that can be encoded
    apart. Units are remembered by a 64-bit hash and their length, up to a bound
    in bytes. New ones are encoded some to a text, which their bytes tell apart
    again: a token stands for as many bytes as it has letters. Every unit's bytes
    are compared with those that were encoded; a text with a unit that only has
    the same hash, and units that the tokenizer has joined, are encoded as they
    are. So are long units, as texts without spaces are; they are not remembered.
    """

    def __init__(self, definition: str):
        # Spark runs a task a core; threads of the tokenizer's own would only wait beside them
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # no unit comes twice
        spec = json.loads(definition)
        step = spec.get("pre_tokenizer") or {}
        self.units = step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(size)], np.int64)
        self._forget()

    @property
    def remembered(self) -> int:
        """Bytes that are remembered."""
        return self.text_used + 4 * self.used + UNIT_BYTES * len(self.known)

    def _forget(self) -> None:
        self.known, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.text, self.text_at, self.text_used = np.zeros(1 << 20, np.uint8), np.zeros(0, np.int64), 0

    def _keep_text(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the bytes of new units are kept."""
        sizes = end - start
        ends = np.cumsum(sizes)
        if self.text_used + ends[-1] > len(self.text):
            self.text = np.concatenate([self.text[: self.text_used], np.zeros(len(self.text) + ends[-1], np.uint8)])
        self.text[self.text_used : self.text_used + ends[-1]] = data[np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1])]
        at = self.text_used + ends - sizes
        self.text_used += int(ends[-1])
        return at

    def _plain(self, data: np.ndarray) -> np.ndarray:
        return np.array(self.tokenizer.encode(data.tobytes().decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def _keep(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(self.pool) + len(ids), np.uint32)])
        at = self.used
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of new units lie, and how many they are."""
        at, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        many = np.flatnonzero(joinable)
        if len(many):
            sizes = end[many] - start[many]
            ends = np.cumsum(sizes)
            joined = data[np.repeat(start[many] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()
            borders = [0, *ends[JOINED - 1 : -1 : JOINED].tolist(), int(ends[-1])]
            texts = [joined[a:b].decode("utf-8") for a, b in zip(borders, borders[1:], strict=False)]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32)
            reached = np.cumsum(self.bytes[ids])
            stop = np.searchsorted(reached, ends)
            if len(reached) and (reached[np.minimum(stop, len(reached) - 1)] == ends).all():
                stop += 1
                begin = np.concatenate([[0], stop[:-1]])
                at[many], size[many] = self._keep(ids) + begin, stop - begin
            else:
                joinable = np.zeros(len(joinable), bool)
        for k in np.flatnonzero(~joinable).tolist():
            ids = self._plain(data[start[k] : end[k]])
            at[k], size[k] = self._keep(ids), len(ids)
        return at, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        if not self.units:
            found = [self._plain(data[offsets[k] : offsets[k + 1]]) for k in range(texts)]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        if self.remembered > REMEMBERED_BYTES:
            self._forget()
        white = _white(data)
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        apart = np.zeros(len(data), bool)
        apart[1:-1] = (data[1:-1] == 32) & ~white[:-2] & ~white[2:] & ~border[1:-2] & ~border[2:-1]
        begins = apart.copy()
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        wide = end - start
        short, long = np.flatnonzero(wide <= LONGEST_UNIT), np.flatnonzero(wide > LONGEST_UNIT)
        own = self.tokenizer.encode_batch_fast([data[start[k] : end[k]].tobytes().decode("utf-8") for k in long.tolist()], add_special_tokens=False) if len(long) else []
        own = [e.ids for e in own]
        at = self._known_units(data, start, end, apart, white, short)
        sizes = np.zeros(len(start), np.int64)
        sizes[short], sizes[long] = self.size[at], [len(ids) for ids in own]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        flat = np.empty(ends[-1], np.uint32)
        within = _counted_up(sizes[short])
        flat[np.repeat(begins[short], sizes[short]) + within] = self.pool[np.repeat(self.start[at], sizes[short]) + within]
        for k, ids in zip(long.tolist(), own, strict=True):
            flat[begins[k] : ends[k]] = ids
        first = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        # every remembered unit's bytes against the data's
        within = _counted_up(wide[short])
        kept = self.text.take(np.repeat(self.text_at[at], wide[short]) + within, mode="clip")
        # units lie one after another, so without long ones their bytes are the data's
        places = np.repeat(start[short], wide[short]) + within if len(long) else None
        differ = np.flatnonzero(kept != (data if places is None else data[places]))
        other = np.concatenate([differ if places is None else places[differ], start[short][self.length[at] != wide[short]]])
        if len(other):
            parts = [flat[first[k] : first[k + 1]] for k in range(texts)]
            for k in np.unique(np.searchsorted(offsets, other, "right") - 1).tolist():
                parts[k] = self._plain(data[offsets[k] : offsets[k + 1]])
            flat, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return flat, first

    def _known_units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, apart: np.ndarray, white: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Where among what is remembered the units ``short`` are, after the new ones of them are encoded."""
        if not len(short):
            return np.zeros(0, np.int64)
        hashed = span_hashes(data, start[short], [end[short]], lower=False)[0]
        distinct, place, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        place = short[place]
        at = np.searchsorted(self.known, distinct)
        length = (end - start)[place]
        inside = np.minimum(at, max(len(self.known) - 1, 0))
        new = np.ones(len(distinct), bool) if not len(self.known) else self.known[inside] != distinct
        if new.any():
            where = place[new]
            joinable = apart[start[where]] & ~white[end[where] - 1]
            pool_at, pool_size = self._ids_of(data, start[where], end[where], joinable)
            slots = at[new]
            self.known = np.insert(self.known, slots, distinct[new])
            self.length = np.insert(self.length, slots, length[new])
            self.text_at = np.insert(self.text_at, slots, self._keep_text(data, start[where], end[where]))
            self.start = np.insert(self.start, slots, pool_at)
            self.size = np.insert(self.size, slots, pool_size)
            at = np.searchsorted(self.known, distinct)
        return at[inverse]


def _counted_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of runs of ``sizes``, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


_encoders: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """This worker's encoder, which later tasks find again with what it remembers."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def cuts(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """For each id stream the ends of its chunks, counted over all streams.

    A cut is a function of the SEEN ids before it, where a chunk then has LEAST ids at least; no chunk has over MOST.
    """
    n = len(ids)
    marks = np.zeros(0, np.int64)
    if n >= SEEN:
        v = mix(ids.astype(np.uint64) + np.uint64(1))
        rolled = np.zeros(n - SEEN + 1, np.uint64)
        for k in range(SEEN):
            rolled *= np.uint64(0x9E3779B97F4A7C15)
            rolled += v[k : n - SEEN + 1 + k]
        marks = np.flatnonzero((mix(rolled) & np.uint64(MEAN - 1)) == 0) + SEEN
    lows, highs = np.searchsorted(marks, first[:-1] + SEEN).tolist(), np.searchsorted(marks, first[1:]).tolist()
    marks, first = marks.tolist(), first.tolist()
    out = []
    for k in range(len(first) - 1):
        begin, stop, ends = first[k], first[k + 1], []
        for end in marks[lows[k] : highs[k]]:
            while end - begin > MOST:
                begin += MOST
                ends.append(begin)
            if end - begin >= LEAST:
                ends.append(end)
                begin = end
        while stop - begin > MOST:
            begin += MOST
            ends.append(begin)
        if begin < stop:
            ends.append(stop)
        out.append(ends)
    return out


def pack(ids: np.ndarray) -> bytes:
    narrow = len(ids) == 0 or int(ids.max()) < 1 << 16
    return (b"\2" if narrow else b"\4") + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[:1] == b"\2" else "<u4", offset=1).astype("<u4")


def content_hash(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of the binary tree over ``hashes``; an odd one out moves up."""
    level = [hashlib.blake2b(b"\0" + h, digest_size=16).digest() for h in hashes]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[k] + level[k + 1], digest_size=16).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else hashlib.blake2b(digest_size=16).digest()


# --- crc32 of concatenated parts, from the parts' own -----------------------

_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo crc32's, bits reflected."""
    out, a, b = np.zeros_like(a), a.copy(), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return out


@functools.cache
def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """x**(32 n) for n below 2**12, and for multiples of that below 2**24: what a crc is multiplied by when n more ids of 4 bytes follow."""
    tables = []
    step = np.array([1 << (31 - 16)], np.uint32)
    step = _times(step, step)  # x**32
    for _ in range(2):
        out = np.array([1 << 31], np.uint32)
        for _ in range(12):
            out = np.concatenate([out, _times(out, np.full(len(out), step[0], np.uint32))])
            step = _times(step, step)
        tables.append(out)
    return tables[0], tables[1]


def joined_crc(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each document from all chunks' crc32s and sizes in ids, and where each document's begin.

    A crc of a whole is the sum of its parts', each moved on by the ids behind it.
    """
    counts = np.diff(first)
    if not len(crcs):
        return np.zeros(len(counts), np.int64)
    through = np.cumsum(sizes)
    behind = np.repeat(through[np.maximum(first[1:] - 1, 0)], counts) - through
    low, high = _shift_tables()
    moved = _times(crcs.astype(np.uint32), low[behind & 4095])
    far = np.flatnonzero(behind >> 12)
    while len(far):
        moved[far] = _times(moved[far], high[np.minimum(behind[far] >> 12, 4095)])
        behind = behind - (np.minimum(behind >> 12, 4095) << 12)
        far = far[behind[far] >> 12 > 0]
    out = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(moved, first[:-1][some])
    return out


# --- writing and reading ----------------------------------------------------

def _chunked(flat: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Roots and chunks of id streams."""
    ends = cuts(flat, first)
    hashes, packs, sizes, roots, counts = [], [], [], [], [0]
    narrow = flat.astype("<u2").tobytes() if not len(flat) or int(flat.max()) < 1 << 16 else None
    for k, own in enumerate(ends):
        begin = int(first[k])
        for end in own:
            packed = b"\2" + narrow[2 * begin : 2 * end] if narrow is not None else pack(flat[begin:end])
            packs.append(packed)
            hashes.append(content_hash(packed))
            sizes.append(end - begin)
            begin = end
        roots.append(merkle_root(hashes[counts[-1] :]))
        counts.append(len(hashes))
    chunk = pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(packs, pa.binary())], ["hash", "n_ids", "ids"])
    return pa.array(roots, pa.binary()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), chunk)


def _encoded(docs: DataFrame, definition: str, text: str) -> DataFrame:
    """doc_id, n_tokens, root and chunks with their ids, one row a document."""
    sent = docs.sparkSession.sparkContext.broadcast(definition)  # the tokenizer's file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for part, data, offsets in slices(batches):
            ids, first = encoder.encode(data, offsets)
            closed = first + np.arange(len(first))
            flat = np.full(closed[-1], END, np.uint32)
            inside = np.ones(len(flat), bool)
            inside[closed[1:] - 1] = False
            flat[inside] = ids
            roots, chunks = _chunked(flat, closed)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(closed)), roots, chunks], ["doc_id", "n_tokens", "root", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, root binary, chunks array<struct<hash binary, n_ids int, ids binary>>")


def write(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text") -> None:
    """Encode ``docs`` into a store at ``path``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    staged = materialize(_encoded(docs, definition, text), "token-staging")
    chunks = staged.select(F.explode("chunks").alias("chunk")).select("chunk.*")
    chunks = chunks.groupBy("hash").agg(F.first("n_ids").alias("n_ids"), F.first("ids").alias("ids"), F.count("*").alias("uses"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.select("doc_id", "n_tokens", "root", F.transform("chunks", lambda c: F.struct(c["hash"].alias("hash"), c["n_ids"].alias("n_ids"))).alias("chunks"))
    parts = max(1, -(-staged.count() // ROWS_OF_PART))
    ordered = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "token-recipes")
    drop(staged)
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    # parts are few: at most one for every ROWS_OF_PART documents
    totals = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("part_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed = ordered.join(totals.select("part", "part_start"), "part")
    placed = placed.select(
        "part", F.row_number().over(order).alias("place"), "doc_id",
        (F.col("part_start") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")).alias("start"),
        "n_tokens", "root", "chunks",
    )
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    spark = docs.sparkSession
    stored = spark.read.schema(placed.schema).parquet(f"{path}/recipes")
    roots = stored.groupBy("part").agg(_part_root().alias("root"))
    manifest = totals.select("part", F.col("part_start").alias("start"), "n_documents", "n_tokens").join(roots, "part")
    manifest = manifest.withColumn("id_type", F.lit(docs.schema["doc_id"].dataType.simpleString()))
    manifest.write.parquet(f"{path}/manifest")
    drop(ordered)


def _part_root():
    """Hash over a part's recipes in order; a part holds about ROWS_OF_PART of them."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "start", "root"))), lambda r: F.concat_ws(":", r["start"], F.hex(r["root"]))), ","), 256)


_RECIPE = "part int, place int, doc_id {}, start long, n_tokens long, root binary, chunks array<struct<hash binary, n_ids int>>"


def _require(ok, message: str):
    return F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """hash, n_ids, uses and crc32 of every stored chunk, its ids read and its hash recomputed."""

    @F.arrow_udf("intact boolean, crc long")
    def look(hashes: pa.Array, packed: pa.Array) -> pa.Array:
        data = packed.to_pylist()
        intact = [content_hash(p) == h for h, p in zip(hashes.to_pylist(), data, strict=True)]
        crc = [zlib.crc32(unpack(p).tobytes()) for p in data]
        return pa.StructArray.from_arrays([pa.array(intact, pa.bool_()), pa.array(crc, pa.int64())], ["intact", "crc"])

    rows = spark.read.schema("hash binary, n_ids int, ids binary, uses long").parquet(f"{path}/chunks")
    rows = rows.withColumn("found", look("hash", "ids"))
    return rows.select("hash", "n_ids", "uses", F.col("found.crc").alias("crc"), F.col("found.intact").alias("intact"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone, all hashes checked.

    Chunks are read and checked once; what is joined to the recipes is each
    chunk's crc32 and size, from which a document's crc32 follows. A chunk that
    very many recipes name is broadcast to them.
    """
    manifest = spark.read.schema("part int, start long, n_documents long, n_tokens long, root string, id_type string").parquet(f"{path}/manifest")
    kind = manifest.select("id_type").first()
    recipes = spark.read.schema(_RECIPE.format(kind[0] if kind else "bigint")).parquet(f"{path}/recipes")
    found = recipes.groupBy("part").agg(_part_root().alias("root"), F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("start"))
    facts = ("root", "n_documents", "n_tokens", "start")
    parts = found.select("part", F.struct(*facts).alias("found")).join(manifest.select("part", F.struct(*facts).alias("told")), "part", "full")
    same = F.lit(True)
    for fact in facts:
        same = same & (F.col(f"found.{fact}") == F.col(f"told.{fact}"))
    # a part that is missing has no recipe to fail, so all parts speak for the store
    parts = parts.select(_require(same, "a part of the store doesn't match its manifest").alias("intact")).agg(F.bool_and("intact").alias("store_intact"))

    @F.arrow_udf("boolean")
    def root_holds(roots: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([merkle_root(h) == r for r, h in zip(roots.to_pylist(), hashes.to_pylist(), strict=True)], pa.bool_())

    @F.arrow_udf("long")
    def crc_of(crcs: pa.Array, sizes: pa.Array) -> pa.Array:
        first = np.concatenate([[0], np.cumsum(np.asarray(crcs.value_lengths()))])
        return pa.array(joined_crc(np.asarray(crcs.flatten()), np.asarray(sizes.flatten()).astype(np.int64), first))

    ids = F.aggregate("chunks", F.lit(0).cast("long"), lambda total, c: total + c["n_ids"])
    rows = recipes.withColumn("recipe_intact", _require(root_holds("root", F.col("chunks.hash")) & (ids == F.col("n_tokens")), "a recipe doesn't match its root"))
    pieces = rows.select("part", "place", "doc_id", "start", "n_tokens", "recipe_intact", F.posexplode("chunks").alias("at", "chunk"))
    pieces = pieces.select("*", F.col("chunk.hash").alias("hash"), F.col("chunk.n_ids").alias("recipe_n")).drop("chunk")
    chunks = materialize(checked_chunks(spark, path), "token-chunks")
    total = chunks.agg(F.sum("uses")).first()[0] or 0
    pieces = join_facts(pieces, chunks, "hash", "uses", total, F.xxhash64("part", "place", "at"))
    pieces = pieces.crossJoin(F.broadcast(parts))  # one row
    intact = _require(F.col("intact") & F.col("recipe_intact") & F.col("store_intact") & (F.col("n_ids") == F.col("recipe_n")), "a chunk is missing or doesn't match its hash")
    pieces = pieces.withColumn("ok", intact).where("ok")
    whole = pieces.groupBy("part", "place", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("at", "crc", "n_ids"))).alias("parts"))
    return whole.select("doc_id", "start", "n_tokens", crc_of(F.col("parts.crc"), F.col("parts.n_ids")).alias("ids_crc32"))


def default_path(spark: SparkSession) -> str:
    return new_path(spark, "token-store")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
