"""Language identification: a bidirectional GRU over bytes that labels every position.

A text is cut into windows of ``WINDOW`` bytes; every position of every window
gets class probabilities, and a document's are the mean over all its positions.
One class more than languages is learned from made-up windows, words of evenly
drawn letters and runs of scripts that the sample doesn't hold: what it takes is
none of the languages. ``foreign`` is its probability; ``accepted`` goes by it.

Edge cases: a null text, an empty one or one without a letter is ``und`` with
score 0. Rows with a null language are never learned from. An empty table, or
one without a labelled training row, gives ``und`` for every row. Repeated
rows and ids are each scored on their own; a tie goes to the first language by
name. Other columns pass through; the operator's own output names replace
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import fold, sample_by
from .text import buffers

#: Training rows per language (the classifier is fitted on this bounded sample) and windows of each, spread over its text.
PER_LANGUAGE, WINDOWS_OF_TEXT = 400, 16
TRAIN_WINDOW, HIDDEN, STEPS, ROWS = 64, 8, 300, 128
WINDOW, WINDOWS_AT_ONCE = 96, 2048
UNDETERMINED = "und"
#: A label is contradicted by another language of at least this score.
SURE = 0.9
#: Made-up windows, and blocks of code points that they are drawn from unless the sample holds them.
FOREIGN, SCRIPT_SHARE = 4000, 1e-3
SCRIPTS = ((0x391, 0x3C9), (0x410, 0x44F), (0x531, 0x586), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def _windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the bytes in each, and each window's text."""
    sizes = np.diff(offsets)
    many = -(-sizes // width)
    doc = np.repeat(np.arange(len(sizes)), many)
    at = (np.arange(len(doc)) - np.concatenate([[0], np.cumsum(many)])[doc]) * width
    lengths = np.minimum(width, sizes[doc] - at)
    padded = np.concatenate([data, np.full(width, gru.PAD, np.uint8)])
    out = padded[(at + offsets[:-1][doc])[:, None] + np.arange(width)]
    out[np.arange(width) >= lengths[:, None]] = gru.PAD
    return out, lengths, doc


def _foreign(r: np.random.Generator, sampled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows in none of the languages: even letters, and scripts that the ``sampled`` windows don't use."""
    sample = np.frombuffer(b"".join(sampled).decode("utf-8", "ignore").encode("utf-32-le", "replace"), "<u4")
    unused = [(a, b) for a, b in SCRIPTS if ((sample >= a) & (sample <= b)).mean() < SCRIPT_SHARE] if len(sample) else list(SCRIPTS)
    alphabets = [(97, 122), (97, 122)] + unused
    made = []
    for k in range(FOREIGN):
        # half of the windows are in the first alphabet, the others in one each
        low, high = alphabets[0 if k % 2 else (k // 2) % len(alphabets)]
        words = [r.integers(low, high + 1, n) for n in r.integers(2, 12, 12)]
        text = " ".join("".join(map(chr, w)) for w in words)
        made.append(text.encode()[int(r.integers(0, 3)) :][:TRAIN_WINDOW])
    data, offsets = buffers(pa.array([b"".join(made)], pa.binary()))
    lengths = np.array([len(m) for m in made], np.int64)
    out = np.full((len(made), TRAIN_WINDOW), gru.PAD, np.uint8)
    out[np.arange(TRAIN_WINDOW) < lengths[:, None]] = data
    return out, lengths


def _sampled_windows(text):
    """WINDOWS_OF_TEXT windows of TRAIN_WINDOW bytes spread evenly over a text, or all where it has fewer."""
    data = F.encode(F.col(text), "UTF-8")
    many = F.ceil(F.octet_length(data) / F.lit(TRAIN_WINDOW)).cast("int")
    n = F.least(many, F.lit(WINDOWS_OF_TEXT))
    at = lambda k: F.floor(k.cast("long") * many / F.greatest(n, F.lit(1))).cast("int") * TRAIN_WINDOW + 1
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.substring(data, at(k), F.lit(TRAIN_WINDOW)))


def fit(docs: DataFrame, seed: int = 7) -> Model | None:
    """Learn from ``text`` and non-null ``lang`` of ``docs``, on windows of at most PER_LANGUAGE rows a language.

    Windows are cut where the texts are; the driver gets at most WINDOWS_OF_TEXT of TRAIN_WINDOW bytes a row.
    """
    rows = docs.where(F.length("text") > 0).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    found = sample_by(rows, "lang", PER_LANGUAGE).select("lang", _sampled_windows("text").alias("windows")).collect()
    rows = sorted((r.lang, bytes(w)) for r in found for w in r.windows)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    data, offsets = buffers(pa.array([w for _, w in rows], pa.binary()))
    windows, lengths, doc = _windows(data, offsets, TRAIN_WINDOW)
    label = np.array([languages.index(lang) for lang, _ in rows])[doc]
    # every language gets as many windows
    draws = np.random.default_rng(seed + 1)
    pick, label = zip(*[(w := np.flatnonzero(label == k)[draws.integers(0, n, 4000)], np.full(len(w), k)) for k in range(len(languages)) if (n := int((label == k).sum()))], strict=True)
    pick, label = np.concatenate(pick), np.concatenate(label)
    made, made_lengths = _foreign(np.random.default_rng(seed + 2), [w for _, w in rows])
    windows, lengths = np.concatenate([windows[pick], made]), np.concatenate([lengths[pick], made_lengths])
    label = np.concatenate([label, np.full(len(made), len(languages))])
    return Model(languages, gru.prepare(gru.train(windows, lengths, label, len(languages) + 1, HIDDEN, STEPS, ROWS, seed)))


def position_labels(model: Model, text: str) -> list[str]:
    """The language of every byte of ``text``."""
    data, offsets = buffers(pa.array([text]))
    windows, lengths, _ = _windows(data, offsets, WINDOW)
    if not len(windows):
        return []
    best = gru.predict(model.weights, windows, lengths)[:, :, :-1].argmax(axis=2).T
    return [model.languages[k] for row, n in zip(best, lengths, strict=True) for k in row[:n]]


def _score(model: Model, texts: pa.Array) -> pa.Array:
    data, offsets = buffers(texts)
    sizes = np.diff(offsets)
    total = np.zeros((len(sizes), len(model.languages) + 1))
    votes = np.zeros((len(sizes), len(model.languages)))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WINDOW * WINDOWS_AT_ONCE, "right")) - 1)
        windows, lengths, doc = _windows(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], WINDOW)
        for k in range(0, len(windows), WINDOWS_AT_ONCE):
            part, n, whose = windows[k : k + WINDOWS_AT_ONCE], lengths[k : k + WINDOWS_AT_ONCE], doc[k : k + WINDOWS_AT_ONCE] + at
            inside = (np.arange(WINDOW)[:, None] < n)[:, :, None]
            prob = gru.predict(model.weights, part, n) * inside
            np.add.at(total, whose, prob.sum(axis=0))
            known = prob[:, :, :-1]
            np.add.at(votes, whose, ((known == known.max(axis=2, keepdims=True)) & inside).sum(axis=0))
        at = to
    rows, best = np.arange(len(sizes)), total[:, :-1].argmax(axis=1)
    some = np.maximum(sizes, 1)
    return pa.StructArray.from_arrays(
        [pa.array([model.languages[k] for k in best], pa.string()), *[pa.array(np.clip(x / some, 0.0, 1.0)) for x in (total[rows, best], votes[rows, best], total[:, -1])]],
        ["lang", "score", "share", "foreign"],
    )


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score, position_share (of positions whose own label is lang_pred) and foreign (the probability of no learned language)."""
    if model is None:
        found = F.struct(F.lit(UNDETERMINED).alias("lang"), *[F.lit(0.0).alias(c) for c in ("score", "share", "foreign")])
    else:

        @F.arrow_udf("lang string, score double, share double, foreign double")
        def found_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield _score(model, texts)

        found = found_of(F.col(text))
    real = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.drop("lang_pred", "score", "position_share", "foreign").withColumn("__found", found)
    return out.select(
        *[c for c in out.columns if c != "__found"],
        F.when(real, F.col("__found.lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(real, F.col("__found.score")).otherwise(0.0).alias("score"),
        F.when(real, F.col("__found.share")).otherwise(0.0).alias("position_share"),
        F.when(real, F.col("__found.foreign")).otherwise(0.0).alias("foreign"),
    )


def accepted(docs: DataFrame, model: Model | None, text: str = "text", label: str = "lang") -> DataFrame:
    """The documents whose language is known, with their own columns.

    Those without a letter go, those that the network takes for none of its
    languages rather than for the best of them, and those whose ``label``, if
    not null, is contradicted by a language of score ``SURE``. Without a model
    only documents without a letter go.
    """
    keep = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.where(keep)
    names = {c: f"__own{k}" for k, c in enumerate(docs.columns)}
    own = docs.where(keep).select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = identify(own, model, names[text])
    sure = F.col("score") >= SURE
    wrong = F.coalesce(F.col(names[label]) != F.col("lang_pred"), F.lit(False)) & sure if label in names else F.lit(False)
    kept = found.where((F.col("foreign") <= F.col("score")) & ~wrong)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(3) != 1)
