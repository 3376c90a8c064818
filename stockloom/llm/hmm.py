"""Language-model scores of documents by a hidden Markov model.

A token is a symbol and a word of it: each of the WORDS commonest training
words is a symbol of its own, other words share a symbol with those that begin
and end alike. States emit symbols; a symbol gives its words in proportion to
their training counts plus one, with one more share for words never seen. So

    P(text) = prod P(word | symbol) * sum over state paths of prod P(state | state before) P(symbol | state)

and the sum is the scaled forward recursion over the whole text. States are
trained by Baum-Welch: tasks take expected counts over all training documents
(in segments of SEGMENT tokens), Spark adds them up, and the driver, which
only ever holds the model's own size, takes the next parameters.

Word counts never meet in one place: blocks of documents send their distinct
words to hash buckets, buckets add the counts up and send each block the
counts of its own words, in the order in which the block holds them. Where many
blocks send to a bucket, groups of blocks are added up first and get their
counts back by the same way, so no task holds more than GROUP blocks or groups.

Words are compared by 64-bit hashes. Edge cases: a null or empty text is the
end token alone. A text of more than LONG tokens is scored in stretches side by
side, each by the product of its steps' matrices, which is the same sum. Without training documents every count is 0, and both scores
of a token are log10(1 / 1). Repeated rows are separate documents. A null id
is hashed as the empty text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_type, id_text
from .store import materialize
from .text import NOT_SPACE, mix, slices, words

#: Commonest words that are symbols, symbols of the others (a power of two), hidden states.
WORDS, SHAPES, STATES = 4096, 1024, 8
END = np.uint64(0x5BD1E995_00000000)
SEGMENT, SEGMENTS_AT_ONCE = 256, 1024
#: Rounds over all training documents, and before them on SAMPLE segments to start from.
ROUNDS, FIRST_ROUNDS, SAMPLE = 3, 25, 1500
PRIOR = 0.02
#: Bytes of text of a block of documents, documents for a bucket of words, and blocks that a task adds up.
BLOCK_BYTES, BUCKET_DOCS, GROUP = 6 << 20, 4096, 1024
#: Buckets whose facts are added up at once, and rows of facts that may come to the driver.
FACTS, MOST_ROWS = 256, 16
#: Tokens of a text that are scored one after another, and of a stretch of a longer one.
LONG, STRETCH = 16_384, 512


@dataclass
class Vocabulary:
    """Of fixed size: the commonest words' hashes, and each symbol's log10 of its total share."""

    common: np.ndarray  # sorted hashes
    order: np.ndarray  # symbol of each
    shape_logs: np.ndarray  # [SHAPES] log10(N + V + 1) of each shape's words
    tokens: int
    distinct: int

    @property
    def symbols(self) -> int:
        return WORDS + SHAPES


@dataclass
class Model:
    start: np.ndarray  # [2, STATES]: at a text's beginning, and at a later segment's
    move: np.ndarray
    emit: np.ndarray  # [STATES, symbols]


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and where each text's begin.

    The low bits are the word's shape: its first byte and last two, hashed.
    """
    found = words(data, offsets, NOT_SPACE, lower=True)
    n = len(found.hash)
    hashed = found.hash
    if n:
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
        last, before = low[found.end - 1], low[np.maximum(found.end - 2, found.start)]
        shape = mix(low[found.start] + (last << np.uint64(8)) + (before << np.uint64(16))) & np.uint64(SHAPES - 1)
        hashed = (hashed & ~np.uint64(SHAPES - 1)) | shape
    first = found.first + np.arange(len(found.first))
    out = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = hashed
    out[ends] = END
    return out, first


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


_SCAN = "block long, bucket int, doc_id {}, held_out boolean, data binary, counts binary"


def _scanner(buckets: int, id_type: pa.DataType):
    """Documents as indices into their block's words, and blocks' words with their training counts."""

    def flush(block: int, held: list) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate([h for h, _, _, _ in held])
        training = np.concatenate([np.repeat(~out, np.diff(first)) for _, first, _, out in held])
        known, index = np.unique(flat, return_inverse=True)
        counts = np.bincount(index[training], minlength=len(known)).astype("<i8")
        # words by bucket, then hash: the order in which buckets get them and counts come back
        bucket = _bucket_of(known, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        index = place[index].astype("<u4")
        known, counts, bucket = known[order], counts[order], bucket[order]
        at, n = 0, 0
        data, ids, outs = [], [], []
        for _, first, part_ids, out in held:
            sizes = np.diff(first)
            for size in sizes:
                data.append(index[at : at + size].tobytes())
                at += size
            ids.append(part_ids)
            outs.append(out)
            n += len(sizes)
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(np.full(n, -1, np.int32)), pa.concat_arrays(ids), pa.array(np.concatenate(outs)), pa.array(data, pa.binary()), none], _NAMES
        )
        used, starts = np.unique(bucket, return_index=True)
        stops = np.append(starts[1:], len(bucket))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(used), block)),
                pa.array(used.astype(np.int32)),
                pa.nulls(len(used), id_type),
                pa.nulls(len(used), pa.bool_()),
                pa.array([known[a:b].astype("<u8").tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
            ],
            _NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for part, data, offsets in slices(batches):
            hashes, first = token_hashes(data, offsets)
            held.append((hashes, first, part.column(0), np.asarray(part.column(2))))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from flush(block, held)
                block, held, size = block + 1, [], 0
        if held:
            yield from flush(block, held)

    return run


_NAMES = ["block", "bucket", "doc_id", "held_out", "data", "counts"]


def _add_up(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of a bucket, their counts over all blocks, and each block's positions among them."""
    parts = [np.frombuffer(b, "<u8") for b in table["data"].to_pylist()]
    counts = np.concatenate([np.frombuffer(b, "<i8") for b in table["counts"].to_pylist()])
    known, index = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, index, counts)
    return known, total, np.split(index, np.cumsum([len(p) for p in parts])[:-1])


def _returned(table: pa.Table) -> pa.Table:
    """Each block's counts, in the order of the words it sent; and this bucket's share of the vocabulary's facts, as block -1."""
    known, total, places = _add_up(table)
    some = total > 0
    shape = (known[some] & np.uint64(SHAPES - 1)).astype(np.int64)
    facts = np.stack([np.bincount(shape, weights=total[some], minlength=SHAPES), np.bincount(shape, minlength=SHAPES)]).astype("<i8")
    top = np.argsort(-total, kind="stable")[:WORDS]
    top = top[total[top] > 0]
    common = np.stack([known[top].astype("<u8").view("<i8"), total[top]]).astype("<i8")
    bucket = table["bucket"][0].as_py()
    return pa.table(
        {
            "block": pa.array([*table["block"].to_pylist(), -1], pa.int64()),
            "bucket": pa.array([bucket] * (len(table) + 1), pa.int32()),
            "data": pa.array([*[total[p].tobytes() for p in places], common.tobytes()], pa.binary()),
            "facts": pa.array([*[None] * len(table), facts.tobytes()], pa.binary()),
        }
    )


def _merged(table: pa.Table) -> pa.Table:
    """One row for a group of blocks: its words and their counts."""
    known, total, _ = _add_up(table)
    return pa.table({"block": table["group"][:1], "bucket": table["bucket"][:1], "data": pa.array([known.astype("<u8").tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})


def _handed_on(sent: pa.Table, back: pa.Table) -> pa.Table:
    """Each block's counts, from those of its group's words."""
    _, _, places = _add_up(sent)
    total = np.frombuffer(back["data"][0].as_py(), "<i8")
    data = pa.array([total[p].tobytes() for p in places], pa.binary())
    return pa.table({"block": sent["block"], "bucket": sent["bucket"], "data": data, "facts": pa.nulls(len(sent), pa.binary())})


_RETURNED = "block long, bucket int, data binary, facts binary"


def _counted(sent: DataFrame) -> DataFrame:
    """For every block and bucket the counts of the block's words over all blocks, and the buckets' facts as block -1."""
    most = sent.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    groups = -(-most // GROUP)
    if groups <= 1:
        return materialize(sent.groupBy("bucket").applyInArrow(_returned, _RETURNED), "hmm-counts")
    grouped = sent.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    merged = materialize(grouped.groupBy("bucket", "group").applyInArrow(_merged, "block long, bucket int, data binary, counts binary"), "hmm-groups")
    above = _counted(merged)
    back = above.where("block >= 0").select(F.col("block").alias("group"), "bucket", "data")
    handed = grouped.groupBy("bucket", "group").cogroup(back.groupBy("bucket", "group")).applyInArrow(_handed_on, _RETURNED)
    return materialize(handed.unionByName(above.where("block = -1")), "hmm-counts")


def _reduced(table: pa.Table) -> pa.Table:
    """Sums of facts and the commonest words of several buckets."""
    facts = sum(np.frombuffer(b, "<i8") for b in table["facts"].to_pylist())
    pairs = np.concatenate([np.frombuffer(b, "<i8").reshape(2, -1) for b in table["data"].to_pylist()], axis=1)
    pairs = pairs[:, np.lexsort((pairs[0], -pairs[1]))[:WORDS]]
    group = table["group"][:1] if "group" in table.column_names else pa.array([0], pa.int32())
    return pa.table({"bucket": group, "data": pa.array([pairs.astype("<i8").tobytes()], pa.binary()), "facts": pa.array([np.asarray(facts).tobytes()], pa.binary())})


def _vocabulary(counted: DataFrame, buckets: int) -> Vocabulary:
    parts = counted.where("block = -1").select("bucket", "data", "facts")
    while buckets > MOST_ROWS:
        # groups of bounded size, again and again until few are left
        parts = parts.withColumn("group", F.floor(F.col("bucket") / FACTS).cast("int")).groupBy("group").applyInArrow(_reduced, "bucket int, data binary, facts binary")
        buckets = -(-buckets // FACTS)
    # at most MOST_ROWS rows of fixed size come to the driver
    rows = parts.select("data", "facts").collect()
    if not rows:
        return Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(SHAPES), 0, 0)
    table = _reduced(pa.table({"data": [bytes(r.data) for r in rows], "facts": [bytes(r.facts) for r in rows]}))
    pairs = np.frombuffer(table["data"][0].as_py(), "<i8").reshape(2, -1)
    totals, distinct = np.frombuffer(table["facts"][0].as_py(), "<i8").reshape(2, SHAPES)
    common, counts = pairs[0].view("<u8"), pairs[1]
    shape = (common & np.uint64(SHAPES - 1)).astype(np.int64)
    rest = totals - np.bincount(shape, weights=counts, minlength=SHAPES) + distinct - np.bincount(shape, minlength=SHAPES) + 1
    order = np.argsort(common)
    return Vocabulary(common[order], order, np.log10(rest), int(totals.sum()), int(distinct.sum()))


def _encoder(vocabulary, id_type: pa.DataType):
    """Documents as symbols, with all that scores need but the states."""

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        v = vocabulary.value
        counted = counted.sort_by("bucket")
        # the words themselves lie with the documents' own block
        sent = [(r["bucket"], r["data"]) for r in counted.select(["bucket", "data"]).to_pylist()]
        own = docs.filter(pa.compute.greater_equal(docs["bucket"], 0)).sort_by("bucket")
        docs = docs.filter(pa.compute.less(docs["bucket"], 0))
        known = np.concatenate([np.frombuffer(b, "<u8") for b in own["data"].to_pylist()]) if len(own) else np.zeros(0, np.uint64)
        count = np.concatenate([np.frombuffer(b, "<i8") for _, b in sent]) if sent else np.zeros(0, np.int64)
        shape = (known & np.uint64(SHAPES - 1)).astype(np.int64)
        symbol, inner = WORDS + shape, np.log10(count + 1) - v.shape_logs[shape]
        if len(v.common) and len(known):
            at = np.minimum(np.searchsorted(v.common, known), len(v.common) - 1)
            hit = v.common[at] == known
            symbol[hit], inner[hit] = v.order[at[hit]], 0.0
        base = np.log10(count + 1) - np.log10(v.tokens + v.distinct + 1)
        index = [np.frombuffer(b, "<u4") for b in docs["data"].to_pylist()]
        flat = np.concatenate(index)
        first = np.concatenate([[0], np.cumsum([len(x) for x in index])])[:-1]
        return pa.table(
            {
                "doc_id": docs["doc_id"].combine_chunks(),
                "held_out": docs["held_out"].combine_chunks(),
                "n_tokens": pa.array([len(x) for x in index], pa.int64()),
                "n_known": pa.array(np.add.reduceat((count > 0)[flat].astype(np.int64), first)),
                "base_score": pa.array(np.add.reduceat(base[flat], first)),
                "inner": pa.array(np.add.reduceat(inner[flat], first)),
                "symbols": pa.array([symbol[x].astype("<u2").tobytes() for x in index], pa.binary()),
            }
        )

    return run


def encode(docs: DataFrame, held_out, text: str = "text") -> tuple[DataFrame, Vocabulary]:
    """Encoded documents (written) and the vocabulary of those that aren't held out."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = arrow_type(docs, "doc_id")
    buckets = max(8, docs.count() // BUCKET_DOCS)
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"), held_out.alias("held_out"))
    scanned = materialize(rows.mapInArrow(_scanner(buckets, id_type), _SCAN.format(kind)), "hmm-words")
    sent = scanned.where("bucket >= 0").select("block", "bucket", "data", "counts")
    counted = _counted(sent)
    vocabulary = _vocabulary(counted, buckets)
    shared = spark.sparkContext.broadcast(vocabulary)  # of fixed size
    back = counted.where("block >= 0").select("block", "bucket", "data")
    encoded = scanned.select("block", "bucket", "doc_id", "held_out", "data").groupBy("block").cogroup(back.groupBy("block"))
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, inner double, symbols binary"
    return materialize(encoded.applyInArrow(_encoder(shared, id_type), schema), "hmm-encoded"), vocabulary


# --- Baum-Welch ---------------------------------------------------------------


def segments(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols [SEGMENT, segments], their lengths, longest first, and whether each begins a text."""
    parts = [(x[at : at + SEGMENT], at == 0) for x in texts for at in range(0, len(x), SEGMENT)]
    parts.sort(key=lambda p: -len(p[0]))
    out = np.zeros((SEGMENT, len(parts)), np.int64)
    for k, (x, _) in enumerate(parts):
        out[: len(x), k] = x
    return out, np.array([len(x) for x, _ in parts]), np.array([b for _, b in parts])


def expected(m: Model, symbols: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions over segments, and the log likelihood."""
    n, width = len(lengths), int(lengths[0])
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(width + 1)]  # segments longer than t
    emit = np.ascontiguousarray(m.emit.T)
    alpha = np.zeros((width, n, STATES))
    norm = np.ones((width, n))
    for t in range(width):
        k = live[t]
        before = m.start[np.where(begins[:k], 0, 1)] if t == 0 else alpha[t - 1, :k] @ m.move
        now = before * emit[symbols[t, :k]]
        norm[t, :k] = now.sum(axis=1)
        alpha[t, :k] = now / norm[t, :k, None]
    beta = np.ones((n, STATES))
    moves = np.zeros((STATES, STATES))
    gamma = alpha
    for t in range(width - 2, -1, -1):
        k = live[t + 1]
        ahead = emit[symbols[t + 1, :k]] * beta[:k] / norm[t + 1, :k, None]
        moves += alpha[t, :k].T @ ahead
        gamma[t + 1, :k] *= beta[:k]
        beta[:k] = ahead @ m.move.T
    gamma[0] *= beta
    starts = np.stack([gamma[0][begins].sum(axis=0), gamma[0][~begins].sum(axis=0)])
    inside = np.arange(width)[:, None] < lengths
    flat, weights = symbols[:width][inside], gamma[inside]
    emissions = np.stack([np.bincount(flat, weights=weights[:, s], minlength=WORDS + SHAPES) for s in range(STATES)])
    return starts, moves * m.move, emissions, float(np.log(norm[inside]).sum())


def maximised(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> Model:
    share = lambda x, prior: (x + prior) / (x + prior).sum(axis=1, keepdims=True)
    return Model(share(starts, 1.0), share(moves, 1.0), share(emissions, PRIOR))


def initial(seed: int, texts: list[np.ndarray]) -> Model:
    """Parameters after some rounds on a few segments, from a random assignment of texts to states that tend to stay."""
    r = np.random.default_rng(seed)
    counts = np.ones(WORDS + SHAPES)
    for x in texts:
        np.add.at(counts, x, 1)
    emissions = counts * r.gamma(0.7, size=(STATES, WORDS + SHAPES))
    m = maximised(np.ones((2, STATES)), np.ones((STATES, STATES)) + 50 * np.eye(STATES), emissions)
    if texts:
        symbols, lengths, begins = segments(texts)
        for _ in range(FIRST_ROUNDS):
            m = maximised(*expected(m, symbols, lengths, begins)[:3])
    return m


def _count(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            texts = [np.frombuffer(b, "<u2").astype(np.int64) for b in batch.column(0).to_pylist()]
            if not texts:
                continue
            symbols, lengths, begins = segments(texts)
            for k in range(0, len(lengths), SEGMENTS_AT_ONCE):
                cut = slice(k, k + SEGMENTS_AT_ONCE)
                starts, moves, emissions, likelihood = expected(model.value, symbols[:, cut], lengths[cut], begins[cut])
                found = np.concatenate([starts.ravel(), moves.ravel(), emissions.ravel(), [likelihood]])
                total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "value"])

    return run


def train(spark: SparkSession, encoded: DataFrame, seed: int = 1, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all documents of ``encoded`` that aren't held out."""
    rows = encoded.where("not held_out").select("symbols", "doc_id")
    # about twice as many beginnings as are wanted, by a hash of id and text; so tasks send the driver few and short rows
    draw = F.xxhash64(id_text(), F.lit(3), "symbols")
    several = rows.where(F.length("symbols") > 2)
    chance = min(1.0, 2 * SAMPLE / max(1, several.count()))
    drawn = several.where(F.pmod(draw, F.lit(1 << 30)) < int(chance * (1 << 30))).select(F.substring("symbols", 1, 2 * SEGMENT).alias("symbols"), draw.alias("draw"))
    some = drawn.orderBy("draw", "symbols").limit(SAMPLE).collect()
    model = initial(seed, [np.frombuffer(bytes(r.symbols), "<u2").astype(np.int64) for r in some])
    symbols = WORDS + SHAPES
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        # one row a parameter, however many tasks there are
        summed = rows.select("symbols").mapInArrow(_count(sent), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(2 * STATES + STATES * STATES + STATES * symbols + 1)
        for at, value in summed:
            total[at] = value
        a, b = 2 * STATES, 2 * STATES + STATES * STATES
        model = maximised(total[:a].reshape(2, STATES), total[a:b].reshape(STATES, STATES), total[b:-1].reshape(STATES, symbols))
    return model


def _long(m: Model, text: np.ndarray) -> float:
    """log10 probability of one long symbol sequence: its stretches' matrices are multiplied out side by side, then one after another."""
    emit = np.ascontiguousarray(m.emit.T)
    state = m.start[0] * emit[text[0]]
    total = np.log10(state.sum())
    state = state / state.sum()
    rest = text[1:]
    many = -(-len(rest) // STRETCH)
    sizes = np.minimum(STRETCH, len(rest) - np.arange(many) * STRETCH)
    matrix = np.repeat(np.eye(STATES)[None], many, axis=0)
    logs = np.zeros(many)
    for t in range(STRETCH):
        k = many if many and t < sizes[-1] else max(0, many - 1)
        if not k:
            break
        now = (matrix[:k].reshape(-1, STATES) @ m.move).reshape(k, STATES, STATES) * emit[rest[np.arange(k) * STRETCH + t]][:, None, :]
        norm = now.sum(axis=(1, 2))
        matrix[:k] = now / norm[:, None, None]
        logs[:k] += np.log10(norm)
    for k in range(many):
        state = state @ matrix[k]
        norm = state.sum()
        total += logs[k] + np.log10(norm)
        state /= norm
    return float(total)


def forward(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence, by the scaled forward recursion over all of it."""
    out = np.zeros(len(texts))
    order = [k for k in np.argsort([-len(x) for x in texts], kind="stable") if len(texts[k]) <= LONG]
    for k in set(range(len(texts))) - set(order):
        out[k] = _long(m, texts[k])
    if not order:
        return out
    sizes = np.array([len(texts[k]) for k in order])
    flat = np.concatenate([texts[k] for k in order])
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    emit = np.ascontiguousarray(m.emit.T)
    logs = np.zeros(len(order))
    state = None
    k = len(order)
    for t in range(int(sizes[0])):
        while k and sizes[k - 1] <= t:
            k -= 1
        before = np.repeat(m.start[:1], k, axis=0) if t == 0 else state[:k] @ m.move
        state = before * emit[flat[first[:k] + t]]
        norm = state.sum(axis=1)
        state /= norm[:, None]
        logs[:k] += np.log10(norm)
    out[order] = logs
    return out


def score(docs: DataFrame, held_out, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    encoded, vocabulary = encode(docs, held_out, text)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(spark, encoded))

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(forward(model.value, [np.frombuffer(b, "<u2").astype(np.int64) for b in column.to_pylist()]))

    found = encoded.withColumn("states", of("symbols"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("inner") + F.col("states")).alias("score"))
