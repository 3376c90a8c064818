"""Benchmark decontamination by CGK embedding, bit sampling and edit verification.

Edit distance is counted in words (lower-case runs of letters and digits): an
item is found in a document where some passage is within ``EDITS`` of the
item's words of it.

The CGK walk reads a window with one pointer, that at every step stays or moves
on by a random bit of the step and the word under it; what it reads is the
embedding. Texts at small edit distance give embeddings at small Hamming
distance. Every repetition has a walk of its own and samples a few steps of
it; windows and items that agree on all of them are candidates. The number of
repetitions follows from the target recall and from how often items with as
many edits as are allowed, at random places and evenly spread, agree with
themselves, which is measured on the items. Where ``MOST_REPETITIONS`` don't
reach the target, as with long items, the class is searched exactly instead:
an item with k edits allowed is cut into k + 1 pieces, of which one must be
intact in a passage within the distance. Candidates are verified by exact edit
distance of the item to the text around the window.

Windows begin at every word. A window is embedded only if it can be within the
distance at all: a word that no item of its size has costs an edit, so windows
with more than EDITS of such words are left out. That bound drops no match.

Edge cases: null and empty texts have no window, items without words match
nothing. Several items of equal text are each reported. Repeated documents are
each searched. A null item id or document id is carried as it is. An empty
table of items or documents gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type
from .text import ALNUM, buffers, mix, slices, words

#: Edits allowed, as a share of an item's words.
EDITS = 0.2
RECALL, SAMPLED, MOST_REPETITIONS = 0.995, 4, 96
#: Sizes of one class differ by less than this factor; windows of a class have its least size.
CLASS = 1.3
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 8 << 20


def walks(r: np.random.Generator, repetitions: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every repetition: a random odd factor a step, whose product with a word decides whether the pointer moves on, and which steps are sampled."""
    factors = (r.integers(0, 1 << 63, (repetitions, size), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    sampled = np.zeros((repetitions, size), bool)
    for row in sampled:
        row[r.choice(size, min(SAMPLED, size), replace=False)] = True
    return factors, sampled


def embed(hashes: np.ndarray, at: np.ndarray, stop: np.ndarray, factors: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Keys [repetitions, windows]: what each walk reads of each window at its sampled steps.

    A window begins at word ``at`` and ends before ``stop``; beyond its end the walk reads a filler.
    """
    repetitions, steps = factors.shape
    pointer = np.repeat(at[None, :], repetitions, axis=0)
    key = np.zeros(pointer.shape, np.uint64)
    filled = np.append(hashes, np.uint64(1))
    filler = len(hashes)
    for step in range(steps):
        symbol = filled[np.where(pointer < stop, pointer, filler)]
        rows = np.flatnonzero(sampled[:, step])
        if len(rows):
            key[rows] = mix(key[rows] * np.uint64(31) + symbol[rows] + np.uint64(step))
        symbol *= factors[:, step, None]
        symbol >>= np.uint64(63)
        pointer += symbol.astype(np.int64)
    return key


def edits_within(item: list[int], text: list[int], most: int) -> int | None:
    """Least edit distance of ``item`` to any passage of ``text``, if at most ``most`` (bit-parallel, words as symbols)."""
    n = len(item)
    masks: dict[int, int] = {}
    for k, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << k
    ones, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = ones, 0, n, n
    for word in text:
        eq = masks.get(word, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise, fall = (down | ~(x | up)) & ones, up & x
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        best = min(best, score)
        # a passage may begin at any word: no edit is charged before it
        rise, fall = (rise << 1) & ones, (fall << 1) & ones
        up, down = (fall | ~(x | rise)) & ones, rise & x
    return best if best <= most else None


@dataclass
class Class:
    """Items of about one size: their tables for candidate search."""

    size: int
    factors: np.ndarray
    sampled: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray]]  # by repetition: sorted keys, item of each
    vocabulary: np.ndarray  # bitmap over the words' low bits
    known_least: int
    #: Where the walks don't reach the recall: words of a piece -> sorted hashes of pieces, item of each, its first word in the item.
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None


@dataclass
class Index:
    ids: list
    hashes: list[np.ndarray]
    sizes: np.ndarray
    edits: np.ndarray
    classes: list[Class]
    members: np.ndarray  # bitmap over pairs of an item and one of its words


BITS = 20


def _pair_bits(words_of: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Place of a word and an item in a bitmap of 2 ** (BITS + 2)."""
    return (mix(words_of + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62 - BITS)).astype(np.int64)


def _edited(r: np.random.Generator, item: np.ndarray, edits: int) -> np.ndarray:
    """``item`` after so many random substitutions, deletions and insertions of words."""
    out = item.tolist()
    for _ in range(edits):
        kind, at = r.integers(0, 3), int(r.integers(0, max(1, len(out))))
        new = int(r.integers(0, 1 << 62))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, new)
    return np.array(out, np.uint64)


def _evenly_edited(r: np.random.Generator, item: np.ndarray, edits: int) -> np.ndarray:
    """``item`` after so many edits of random kinds at even distances."""
    out = item.tolist()
    for at in ((np.arange(edits) + 0.5) * len(out) / max(1, edits)).astype(int)[::-1].tolist():
        kind, new = r.integers(0, 3), int(r.integers(0, 1 << 62))
        out[at : at + (kind < 2)] = [] if kind == 1 and len(out) > 1 else [new]
    return np.array(out, np.uint64)


def _runs(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(31) + hashes[at + k])
    return out


def _pieces(hashes: list[np.ndarray], members: list[int], edits: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of every member, one more than its edits, by their words."""
    found: dict[int, list] = {}
    for k in members:
        many = int(edits[k]) + 1
        size = len(hashes[k]) // many
        at = np.arange(many) * len(hashes[k]) // many
        found.setdefault(size, []).append((_runs(hashes[k], at, size), np.full(many, k), at))
    out = {}
    for size, parts in found.items():
        keys, items, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        out[size] = keys[order], items[order], at[order]
    return out


def build(ids: list, texts: list[str], recall: float = RECALL, seed: int = 3) -> Index:
    data, offsets = buffers(pa.array([t or "" for t in texts], pa.large_string()))
    found = words(data, offsets, ALNUM)
    hashes = [found.hash[found.first[k] : found.first[k + 1]] for k in range(len(texts))]
    sizes = np.array([len(h) for h in hashes], np.int64)
    edits = (EDITS * sizes).astype(np.int64)
    some = sorted((k for k in range(len(texts)) if sizes[k]), key=lambda k: (sizes[k], k))
    classes, at = [], 0
    r = np.random.default_rng(seed)
    while at < len(some):
        size = int(sizes[some[at]])
        members = [k for k in some[at:] if sizes[k] < max(size + 1, size * CLASS)]
        at += len(members)
        flat = np.concatenate([hashes[k] for k in members])
        first = np.concatenate([[0], np.cumsum(sizes[members])])
        factors, sampled = walks(r, MOST_REPETITIONS, size)
        # how often members with the edits allowed still agree with themselves on a sample
        whose = (list(range(len(members))) * (1 + 256 // len(members)))[:256]
        tries = [(k, edit(r, hashes[members[k]], int(edits[members[k]]))) for edit in (_edited, _evenly_edited) for k in whose]
        starts = np.concatenate([[0], np.cumsum([len(t) for _, t in tries])])
        keys = embed(flat, first[:-1], first[1:], factors, sampled)
        changed = embed(np.concatenate([t for _, t in tries]), starts[:-1], starts[1:], factors, sampled)
        agree = keys[:, [k for k, _ in tries]] == changed
        by_kind = np.maximum.accumulate(agree, axis=0)
        found_by = np.minimum(by_kind[:, : len(whose)].mean(axis=1), by_kind[:, len(whose) :].mean(axis=1))
        reached = bool((found_by >= recall).any())
        enough = int(np.argmax(found_by >= recall)) + 1 if reached else 0
        table = []
        for key in keys[:enough]:
            order = np.argsort(key, kind="stable")
            table.append((key[order], np.array(members)[order]))
        vocabulary = np.zeros(1 << BITS, bool)
        vocabulary[(flat & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
        # a window of the class's size holds at least this many of an item's words
        known = min(size - int(edits[k]) for k in members)
        classes.append(Class(size, factors[:enough], sampled[:enough], table, vocabulary, known, None if reached else _pieces(hashes, members, edits)))
    members = np.zeros(1 << (BITS + 2), bool)
    for k, h in enumerate(hashes):
        members[_pair_bits(h, np.full(len(h), k))] = True
    return Index(list(ids), hashes, sizes, edits, classes, members)


def _candidates(index: Index, found, c: Class) -> tuple[np.ndarray, np.ndarray]:
    """Windows' first words and items that agree on some sample."""
    n = len(found.hash)
    low = (found.hash & np.uint64((1 << BITS) - 1)).astype(np.int64)
    stop_of = np.repeat(found.first[1:], found.counts)
    known = np.concatenate([[0], np.cumsum(c.vocabulary[low])])
    at = np.flatnonzero(known[np.minimum(np.arange(n) + c.size, stop_of)] - known[:-1] >= c.known_least)
    begins, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(at):
        keys = embed(found.hash, at, np.minimum(stop_of[at], at + c.size), c.factors, c.sampled)
        for key, (known_keys, known_items) in zip(keys, c.keys, strict=True):
            lo, hi = np.searchsorted(known_keys, key, "left"), np.searchsorted(known_keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            many = (hi - lo)[hit]
            begins.append(np.repeat(at[hit], many))
            items.append(known_items[np.repeat(lo[hit], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)])
    pairs = np.unique(np.concatenate(begins) * len(index.ids) + np.concatenate(items))
    return pairs // max(1, len(index.ids)), pairs % max(1, len(index.ids))


def _intact(found, c: Class) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, items and where the item's first word would be, for every piece of an item in a text."""
    n = len(found.hash)
    doc_of, stop_of = found.doc, np.repeat(found.first[1:], found.counts)
    docs, items, begins = ([np.zeros(0, np.int64)] for _ in range(3))
    for size, (keys, of, offset) in c.pieces.items():
        at = np.flatnonzero(np.arange(n) + size <= stop_of)
        runs = _runs(found.hash, at, size)
        lo, hi = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
        hit = np.flatnonzero(hi > lo)
        many = (hi - lo)[hit]
        row = np.repeat(lo[hit], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        docs.append(np.repeat(doc_of[at[hit]], many))
        items.append(of[row])
        begins.append(np.repeat(at[hit], many) - offset[row])
    out = np.unique(np.stack([np.concatenate(x) for x in (docs, items, begins)]), axis=1)
    return out[0], out[1], out[2]


#: Words around candidates that are looked at together.
AROUND = 1 << 22


def _holds_enough(index: Index, hashes: np.ndarray, items: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether as many words as ``least`` between ``low`` and ``high`` are words of the item."""
    many = high - low
    out, total, at = np.zeros(len(low), bool), np.cumsum(many), 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AROUND, "right")))
        part = many[at:to]
        before = np.cumsum(part) - part
        near = np.repeat(low[at:to] - before, part) + np.arange(int(part.sum()))
        held = index.members[_pair_bits(hashes[near], np.repeat(items[at:to], part))]
        out[at:to] = np.add.reduceat(held.astype(np.int64), before) >= least[at:to]
        at = to
    return out


def search(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, item, edits) of all items found in a slice of documents."""
    found = words(data, offsets, ALNUM)
    if not len(found.hash):
        return []
    best: dict[tuple[int, int], int] = {}
    for c in index.classes:
        if c.pieces is None:
            begins, items = _candidates(index, found, c)
            docs = np.searchsorted(found.first, begins, "right") - 1
        else:
            docs, items, begins = _intact(found, c)
        if not len(begins):
            continue
        most, size = index.edits[items], index.sizes[items]
        low, high = np.maximum(found.first[docs], begins - most), np.minimum(found.first[docs + 1], begins + size + 2 * most)
        # all but the edits of an item's words must be around the window
        enough = _holds_enough(index, found.hash, items, low, high, size - most)
        rows = list(zip(*(x[enough].tolist() for x in (docs, items, begins, low, high, most)), strict=True))
        if c.pieces is not None:
            # sorted by document, item and place: overlapping texts are verified once
            spans: list[list[int]] = []
            for doc, item, _, a, b, e in rows:
                if spans and spans[-1][:2] == [doc, item] and a <= spans[-1][3]:
                    spans[-1][3] = max(b, spans[-1][3])
                else:
                    spans.append([doc, item, a, b, e])
            for doc, item, a, b, e in spans:
                edits = edits_within(index.hashes[item].tolist(), found.hash[a:b].tolist(), e)
                if edits is not None:
                    best[doc, item] = min(edits, best.get((doc, item), edits))
            continue
        seen: dict[tuple[int, int], int] = {}
        for doc, item, begin, a, b, e in rows:
            # windows that begin nearby see nearly the same text
            if best.get((doc, item)) == 0 or seen.get((doc, item), -1) >= begin:
                continue
            edits = edits_within(index.hashes[item].tolist(), found.hash[a:b].tolist(), e)
            seen[doc, item] = begin if edits is None else begin + e // 2
            if edits is not None:
                best[doc, item] = min(edits, best.get((doc, item), edits))
    return [(doc, item, edits) for (doc, item), edits in sorted(best.items())]


def _index_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """Search tables of the benchmark, in blocks of bounded size."""
    ids, texts, held = [], [], 0
    for row in items.select(item_id, text).orderBy(item_id, text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1] or "")
        if held >= BLOCK_BYTES:
            yield build(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield build(ids, texts)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``key``, ``item_id``, item_words and edits of every item found in a document; one row a pair.

    The items are a query set: all documents are searched for one block of
    them after another.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"{key} {kind}, {item_id} {item_kind}, item_words int, edits int"
    id_type = arrow_type(items, item_id)
    out = None
    for index in _index_blocks(items, item_id, text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part, data, offsets in slices(batches, text):
                hits = search(index, data, offsets)
                columns = [
                    part.column(0).take(pa.array([d for d, _, _ in hits], pa.int64())),
                    pa.array([index.ids[i] for _, i, _ in hits], id_type),
                    pa.array([len(index.hashes[i]) for _, i, _ in hits], pa.int32()),
                    pa.array([e for _, _, e in hits], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, item_id, "item_words", "edits"])

        found = docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _without(sent):
    """Whether a text holds no item of a broadcast index."""

    @F.arrow_udf("boolean")
    def free(texts: pa.Array) -> pa.Array:
        keep = np.ones(len(texts), bool)
        at = 0
        for part, data, offsets in slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
            keep[[at + doc for doc, _, _ in search(sent.value, data, offsets)]] = False
            at += len(part)
        return pa.array(keep)

    return free


def clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    out = docs
    for index in _index_blocks(items, item_id, text):
        out = out.where(_without(docs.sparkSession.sparkContext.broadcast(index))(F.col(text)))
    return out
