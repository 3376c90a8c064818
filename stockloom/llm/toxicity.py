"""Toxicity: a convolutional text classifier with thresholds calibrated by language.

Words and their prefixes are hashed to embeddings; the first coordinates start
as how much oftener the form is in toxic texts than chance. The network's probability p is
then put on a scale where 0.7 is the threshold of the text's language: below
the threshold t a score is 0.7 p / t, above it rises evenly to 1. The language
is guessed from the text itself, by word counts per language in training rows.

Edge cases: a null or empty text, or one without words, scores as a text with
no response at all, below the threshold. Without labelled training rows of
both classes every score is 0. Rows with a null label are not learned from, a
null language counts in no language's words. A language with fewer than
LEAST_TOXIC toxic calibration rows takes the threshold over all languages.
Repeated rows are each scored on their own. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cnn
from .common import fold, id_text, sample_by
from .text import ALNUM, buffers, slices, words

#: Training rows per label (the classifier is fitted on this bounded sample), and the longest text that is sampled.
PER_LABEL, LONGEST = 2500, 100_000
#: Bytes of the prefixes that stand for a word's stem.
PREFIXES = (4, 6)
#: Bytes of text that are scored at once: every word has some hundred bytes of responses.
SCORED_BYTES = 1 << 18
EPOCHS, ROWS, CUT, LEAST_TOXIC = 6, 16, 0.7, 15


@dataclass
class Model:
    net: cnn.Net
    languages: list[str]
    language_words: np.ndarray  # [BUCKETS, languages] log probabilities, the shared part taken off
    thresholds: np.ndarray  # by language; the last is for all


def _bucket_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = words(data, offsets, ALNUM, prefixes=PREFIXES)
    forms = np.stack([found.hash, *found.prefixes], axis=1)
    return (forms & np.uint64(cnn.BUCKETS - 1)).astype(np.int64), found.first


def _languages_of(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.full(len(first) - 1, len(model.languages))
    some = np.flatnonzero(np.diff(first))
    if len(some) and model.languages:
        out[some] = np.add.reduceat(model.language_words[ids[:, 0]], first[:-1][some], axis=0).argmax(axis=1)
    return out


def _signals(ids: list[np.ndarray], toxic: np.ndarray) -> list[np.ndarray]:
    """For each form, how many standard deviations oftener than chance the texts with it are toxic, damped and scaled."""
    out, share = [], toxic.mean()
    for form in range(1 + len(PREFIXES)):
        both = np.zeros((2, cnn.BUCKETS))
        for words_of, label in zip(ids, toxic, strict=True):
            both[int(label), np.unique(words_of[:, form])] += 1
        n = both.sum(axis=0)
        out.append(np.clip((both[1] - n * share) / np.sqrt(n * share * (1 - share) + 1) / 4, -0.5, 2.0))
    return out


def _threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """Midway between the two probabilities around the best F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + toxic.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # equal probabilities stay together
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + after) / 2, 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model | None:
    """Learn from the texts of ``docs`` that ``labels.toxic`` marks, on about PER_LABEL rows a label."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).select("doc_id", "text", "lang")
    # the few labelled ids first, so that only sampled texts travel
    marked = sample_by(docs.select("doc_id").join(marks, "doc_id"), "__toxic", PER_LABEL).select("doc_id", "__toxic").distinct()
    marked = F.broadcast(marked)  # at most PER_LABEL ids for each of the labels
    # an id may stand on many rows
    rows = sample_by(rows.join(marked, "doc_id"), "__toxic", PER_LABEL)
    found = sorted(rows.select(id_text().alias("id"), "text", F.coalesce("lang", F.lit("")).alias("lang"), "__toxic").collect())
    toxic = np.array([int(r["__toxic"] > 0) for r in found])
    if not len(found) or toxic.min() == toxic.max():
        return None
    ids = []
    for _, data, offsets in slices([pa.RecordBatch.from_arrays([pa.array([r.text for r in found], pa.large_string())], ["text"])]):
        flat, first = _bucket_ids(data, offsets)
        ids += [flat[first[k] : first[k + 1]].astype(np.int32) for k in range(len(first) - 1)]
    languages = sorted({r.lang for r in found} - {""})
    counts = np.zeros((cnn.BUCKETS, max(1, len(languages))))
    for words_of, r in zip(ids, found, strict=True):
        if r.lang:
            np.add.at(counts[:, languages.index(r.lang)], words_of[:, 0], 1)
    logs = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * cnn.BUCKETS))
    logs -= logs.mean(axis=1, keepdims=True)
    # words' signal from one half of the rows trains the net on the other, and the other way about
    r = np.random.default_rng(seed)
    half = r.permutation(len(found)) % 2
    weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    weight = np.minimum(weight, 5.0)
    probability = np.zeros(len(found))
    for side in (0, 1):
        learn, score = np.flatnonzero(half == side), np.flatnonzero(half != side)
        if toxic[learn].min() == toxic[learn].max():
            probability[score] = toxic.mean()
            continue
        net = cnn.init(seed + side, _signals([ids[k] for k in learn], toxic[learn]))
        net = cnn.train(net, [ids[k] for k in learn], toxic[learn], weight[learn], EPOCHS, ROWS, seed)
        probability[score] = [cnn.probability(net, ids[k], np.array([0, len(ids[k])]))[0] for k in score]
    net = cnn.train(cnn.init(seed, _signals(ids, toxic)), ids, toxic, weight, EPOCHS, ROWS, seed)
    model = Model(net, languages, logs.astype(np.float32), np.zeros(0))
    guess = np.array([_languages_of(model, x, np.array([0, len(x)]))[0] for x in ids])
    overall = _threshold(probability, toxic)
    thresholds = [_threshold(probability[guess == k], toxic[guess == k]) if toxic[guess == k].sum() >= LEAST_TOXIC else overall for k in range(len(languages))]
    model.thresholds = np.array([*thresholds, overall])
    return model


def _score(model: Model, texts: pa.Array) -> pa.Array:
    data, offsets = buffers(texts)
    scores, at = np.zeros(len(offsets) - 1), 0
    language = np.full(len(scores), len(model.languages))
    while at < len(scores):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SCORED_BYTES, "right")) - 1)
        ids, first = _bucket_ids(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        p = cnn.probability(model.net, ids, first)
        language[at:to] = _languages_of(model, ids, first)
        t = model.thresholds[language[at:to]]
        over = p >= t
        score = np.where(over, CUT + (1 - CUT) * (p - t) / (1 - t), np.minimum(CUT * p / t, np.nextafter(CUT, 0)))
        score[np.diff(first) == 0] = np.minimum(score[np.diff(first) == 0], 0.5)
        scores[at:to] = np.clip(score, 0, 1)
        at = to
    names = [*model.languages, None]
    return pa.StructArray.from_arrays([pa.array(scores), pa.array([names[k] for k in language], pa.string())], ["score", "language"])


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score, predicted (1 from 0.7) and text_language, the language whose threshold was used."""
    if model is None:
        found = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("language"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS rows

        @F.arrow_udf("score double, language string")
        def found_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield _score(sent.value, texts)

        found = found_of(F.col(text))
    out = docs.drop("score", "predicted", "text_language").withColumn("__found", found)
    return out.select(
        *[c for c in out.columns if c != "__found"],
        F.col("__found.score").alias("score"),
        (F.col("__found.score") >= CUT).cast("int").alias("predicted"),
        F.col("__found.language").alias("text_language"),
    )


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(3) != 1)
