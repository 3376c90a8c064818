"""Bounds of samples and of what workers remember, ids of every type, cuts that move along, identifiers found by their contexts."""

from __future__ import annotations

import datetime as dt
import decimal
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockloom.llm import common, decontam, fingerprint, hmm, jaccard, langid, mixing, pii, sharding, tokenstore, toxicity
from stockloom.llm.text import buffers

WORDS = [a + b for a in ("an", "the", "ing", "or", "est", "re", "on", "tion", "mar") for b in ("ka", "lo", "mi", "nu", "per", "sol", "tev")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


# --- the fitting sample --------------------------------------------------------


def test_sample_is_bounded_where_ids_repeat(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    same = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("de").alias("lang"))
    few = spark.createDataFrame([(1, "x", "fr"), (2, None, "fr"), (3, "y", None)], "doc_id long, text string, lang string")
    found = Counter(r.lang for r in common.sample_by(rows.unionByName(same).unionByName(few), "lang", 400).collect())
    assert 300 < found["en"] <= 400 and found["de"] <= 1 and 1 <= found["fr"] <= 2 and None not in found


def test_sample_of_very_many_labels(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_ROWS", 50)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("l"), F.least("id", F.lit(120))).alias("label"))
    found = Counter(r.label for r in common.sample_by(rows, "label", 30).collect())
    assert len(found) == 50 and set(found.values()) == {1} and found["l120"] == 1


def test_language_windows_not_texts_reach_the_driver(spark):
    r = random.Random(1)
    text = "é" + prose(r, 20_000)
    rows = spark.createDataFrame([(1, text), (2, "short"), (3, "x" * 64)], "doc_id long, text string")
    found = {x.doc_id: [bytes(w) for w in x.w] for x in rows.select("doc_id", langid._sampled_windows("text").alias("w")).collect()}
    assert found[2] == [b"short"] and found[3] == [b"x" * 64]
    whole = text.encode()
    assert len(found[1]) == langid.WINDOWS_OF_TEXT and all(len(w) == langid.TRAIN_WINDOW and whole.find(w) % langid.TRAIN_WINDOW == 0 for w in found[1])
    assert whole.find(found[1][-1]) > 0.9 * len(whole)


def test_toxicity_learns_from_one_id_on_many_rows(spark):
    r = random.Random(2)
    rows = [(1, prose(r, 12) + " vilestuff", "en") for _ in range(3000)] + [(k, prose(r, 12), "en") for k in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 300)], "doc_id long, toxic int")
    out = {x.doc_id: x.predicted for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert out[1] == 1 and sum(out.values()) <= 3


# --- fingerprints ---------------------------------------------------------------


def test_one_word_more_changes_one_piece(spark):
    r = random.Random(4)
    words = [f"{a}{k}" for k, a in enumerate(r.choice(WORDS) for _ in range(800))]
    unspaced = "".join(chr(0x4E00 + r.randrange(6000)) for _ in range(800))
    rows = []
    for text, cut, gap in ((words, lambda w: " ".join(w), " "), (list(unspaced), "".join, "")):
        for at in (0, 1, 100, 399, 700, 800):
            rows += [(len(rows) + 1, cut(text)), (len(rows), cut([*text[:at], "new" if gap else "新", *text[at:]]))]
    # the next document is that of the next lower id
    docs = spark.createDataFrame([(1000 - k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    out = {1000 - x.doc_id: x.near_next for x in fingerprint.fingerprints(docs).collect()}
    assert min(out[k] for k in range(0, len(rows), 2)) >= 0.9


def test_pieces_keep_marks_apart(spark):
    texts = ["ab", "ab", "ab", "ab", "ab", "", " \n ", "\n\na\n\n\nb", "x" * 100_000, "a" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({x.fingerprint for x in fingerprint.fingerprints(docs).collect()}) == len(texts)


# --- token store -----------------------------------------------------------------


@pytest.fixture(scope="module")
def definition():
    with open(tokenstore.default_tokenizer(), encoding="utf-8") as f:
        return f.read()


def test_what_a_worker_remembers_is_bounded(definition, monkeypatch):
    monkeypatch.setattr(tokenstore, "REMEMBERED_BYTES", 1 << 18)
    r = random.Random(5)
    encoder, most = tokenstore.Encoder(definition), 0
    for _ in range(30):
        texts = ["".join(chr(0x4E00 + r.randrange(2000)) for _ in range(2000)) for _ in range(6)] + [" ".join(str(r.randrange(10**9)) for _ in range(2000)), "", "a b " + "z" * 5000 + " c d"]
        ids, first = encoder.encode(*buffers(pa.array(texts)))
        most = max(most, encoder.remembered)
        for k, text in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    # a batch adds to what is remembered before the bound is looked at again
    assert most < (1 << 18) + 6 * 2000 * 60
    before = encoder.remembered
    encoder.encode(*buffers(pa.array(["".join(chr(0x3041 + r.randrange(80)) for _ in range(100_000))])))
    assert encoder.remembered <= before


def test_long_units_among_short_ones(definition):
    r = random.Random(6)
    encoder = tokenstore.Encoder(definition)
    pieces = ["a", " b", "  ", "\n", "日本" * 40, "x" * 65, "x" * 64, " " + "y" * 63, " " + "y" * 64, "é" * 33, "　", "1 2 3", " <|endoftext|> "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(300)]
    for _ in range(2):
        ids, first = encoder.encode(*buffers(pa.array(texts)))
        for k, text in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# --- ids of any type --------------------------------------------------------------

KINDS = {"tinyint": int, "smallint": int, "int": int, "bigint": int, "decimal(12,0)": decimal.Decimal, "date": lambda k: dt.date(2020, 1, 1) + dt.timedelta(k), "string": str}


@pytest.mark.parametrize("kind", KINDS)
def test_ids_of_every_type(spark, kind, tmp_path):
    r = random.Random(7)
    ids, item = [KINDS[kind](k) for k in range(1, 13)], prose(r, 40)
    rows = [(k, f"{prose(r, 30)} {item if n == 3 else ''} {prose(r, 30)}") for n, k in enumerate(ids)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    items = spark.createDataFrame([(ids[0], item)], f"item_id {kind}, text string")
    wanted = Counter(k for k, _ in rows)
    assert [(x.doc_id, x.item_id) for x in decontam.contaminated(docs, items).collect()] == [(ids[3], ids[0])]
    assert Counter(x.doc_id for x in hmm.score(docs, common.fold(7) == 2).collect()) == wanted
    for out in (fingerprint.fingerprints(docs), pii.extract(docs), sharding.shard(docs), mixing.mix(docs), jaccard.similar_documents(docs), langid.identify(docs.select("doc_id", "text"), langid.fit(docs))):
        assert dict(out.dtypes)["doc_id"] == kind and Counter(x.doc_id for x in out.select("doc_id").collect()) == wanted
    path = f"file://{tmp_path}/store"
    tokenstore.write(docs, path, tokenstore.default_tokenizer())
    assert Counter(x.doc_id for x in tokenstore.read(spark, path).collect()) == wanted


# --- personal data -----------------------------------------------------------------


def _with_contexts(r: random.Random, n: int):
    """Documents in which identifiers follow telling words, and numbers that are none follow others."""
    def phone():
        return f"+{r.randrange(1, 99)} {r.randrange(100, 999)} {r.randrange(1000000, 9999999)}"

    def email():
        return f"{r.choice(WORDS)}{r.randrange(10**6)}@{r.choice(WORDS)}.example"

    lines = []
    for _ in range(n):
        lines.append(r.choice([f"please call {phone()} today", f"write to mail: {email()} soon", f"order {r.randrange(10**8, 10**9)} has shipped", f"{prose(r, 6)} {r.randrange(10**8, 10**9)}"]))
    return lines


def test_hidden_identifiers_are_found_by_their_contexts(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(k, f"{prose(r, 10)}\n{line}\n{prose(r, 10)}") for k, line in enumerate(_with_contexts(r, 1200))], "doc_id long, text string")
    found = {x.kind: x for x in pii.held_out(docs).collect()}
    for kind in ("email", "phone"):
        x = found[kind]
        assert x.hidden > 60 and x.found >= 0.9 * x.hidden and x.wrong == 0


def test_spans_hold_what_contexts_find(spark):
    r = random.Random(9)
    lines = [*_with_contexts(r, 600), "please call 0171 9988776 today", "order 555666777 has shipped"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {x.doc_id: x for x in pii.extract(docs).collect()}
    assert out[600].n_phone == 0 and out[600].spans == "phone:12:24" and out[600].n_added == 1
    assert out[601].spans == "" and all(x.spans.count(",") + bool(x.spans) == x.n_found for x in out.values())


def test_tokens_of_any_length_count(spark):
    r = random.Random(10)

    def token():
        part = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(n))
        return f"eyJ{part(60)}.{part(300)}.{part(80)}"

    rows = [(k, f"{prose(r, 5)} bearer token: {token()} {prose(r, 5)}") for k in range(40)]
    out = pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.n_secret == 1 and x.spans == x.secret_spans for x in out)


def test_contexts_hold_whole_words():
    left = "x" * 46 + "word here "
    assert pii._patterns(left + "12345", len(left), len(left) + 5) == ["l|here"]
    text = "call 12345 " + "y" * 40
    assert pii._patterns(text, 5, 10) == ["l|call"]
    text = "call 12345 " + "y" * 20
    assert f"lr|call|{'y' * 20}" in pii._patterns(text, 5, 10)
    assert np.all([p in pii._patterns("Phone: 12345", 7, 12) for p in ("l|phone", "k|phone")])
