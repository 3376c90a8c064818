"""Operators on small tables: against brute force where they are exact, and on edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockloom.llm import cnn, decontam, fingerprint, gru, hmm, jaccard, langid, license, mixing, pii, queries, tokenstore, toxicity
from stockloom.llm.common import fold
from stockloom.llm.text import NOT_SPACE, buffers, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int, stems=("an", "the", "ing", "or", "est", "re", "on", "tion")) -> str:
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], SCHEMA)


def edge_rows():
    r = random.Random(3)
    long = prose(r, 6000)
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "   \n", None, "a"), (4, "x", "en", "b"), (None, "no id here at all", "en", "b"), (5, long, "en", "a")]
    rows += [(6, "twice the same row of words", "de", "c")] * 2 + [(7, "eins zwei drei 日本語 ñ é", "de", None), (7, "same id and another text", None, "c")]
    return rows


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, edge_rows()).withColumns({"row": F.lit(1), "score": F.lit(2.0), "key": F.lit("k"), "label": F.lit(0)})


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def pairs_of(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}


# --- words and shingles -------------------------------------------------------------


@given(st.lists(st.text(alphabet="aB é\n\t日x.", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_and_shingles_match_python(texts):
    data, offsets = buffers(pa.array(texts, pa.string()))
    found = words(data, offsets, NOT_SPACE)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) for t in texts]
    assert found.counts.tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    names = {}
    for w, h in zip(flat, found.hash.tolist(), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    values, first = shingles(found, 3)
    for k, ws in enumerate(expected):
        want = len({tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}) if ws else 0
        assert first[k + 1] - first[k] == want


# --- 1 language ----------------------------------------------------------------------


def test_gru_gradients_and_inference():
    r = np.random.default_rng(0)
    p = gru.init(3, 4, 1)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    windows, lengths, label = r.integers(1, 50, (5, 6)).astype(np.uint8), np.array([6, 6, 4, 2, 1]), np.array([0, 1, 2, 1, 0])
    for k in range(5):
        windows[k, lengths[k] :] = 0

    def loss():
        logits = gru.states(p, windows, lengths).astype(np.float64) @ p["out"] + p["out_bias"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
        inside = np.arange(6)[:, None] < lengths
        return -np.log(prob[:, np.arange(5), label])[inside].mean()

    g = gru.gradients(p, windows, lengths, label)
    for name, at in (("rec", (0, 1, 2)), ("rec", (1, 2, 9)), ("table", (0, int(windows[0, 0]), 3)), ("table", (1, int(windows[1, 2]), 8)), ("bias", (0, 0, 9)), ("out", (2, 1))):
        held = p[name][at]
        p[name][at] = held + 1e-3
        up = loss()
        p[name][at] = held - 1e-3
        down = loss()
        p[name][at] = held
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3
    logits = gru.states(p, windows, lengths) @ p["out"] + p["out_bias"]
    prob = np.exp(logits - logits.max(axis=2, keepdims=True))
    prob /= prob.sum(axis=2, keepdims=True)
    assert np.abs(gru.predict(gru.prepare(p), windows, lengths) - prob).max() < 1e-5


def test_language_held_out_accuracy_and_edges(spark, edges, nothing):
    r = random.Random(1)
    kinds = {"en": ("the", "ing", "and", "th"), "fr": ("é", "eau", "le", "qu"), "de": ("sch", "ü", "ei", "der")}
    rows = [(k, prose(r, r.randint(5, 40), kinds[lang]), lang, "s") for k, lang in zip(range(240), itertools.cycle(kinds), strict=False)]
    docs = table(spark, rows)
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs, model).where(fold(3) == 1).select("lang", "lang_pred").collect()
    assert len(found) > 40 and sum(x.lang == x.lang_pred for x in found) > 0.97 * len(found)
    assert langid.position_labels(model, "the and thing") == ["en"] * 13
    out = langid.identify(edges, model).collect()
    assert len(out) == len(edge_rows())
    assert all(0 <= x.score <= 1 for x in out)
    assert {x.lang_pred for x in out if not re.search(r"[^\W\d_]", x.text or "")} == {"und"}
    assert langid.fit(nothing) is None and langid.identify(nothing, None).count() == 0
    assert {x.lang_pred for x in langid.identify(edges, None).collect()} == {"und"}


# --- 2 mixing ------------------------------------------------------------------------


def _duck(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])))
    result = con.execute(query)
    names = [d[0] for d in result.description]
    return sorted((tuple(dict(zip(names, row, strict=True))[n] for n in sorted(names)) for row in result.fetchall()), key=repr)


def test_mixing_matches_sql_and_targets(spark, nothing):
    r = random.Random(5)
    rows = [(k, prose(r, r.randint(0, 60)), "en", r.choice(["a", "a", "a", "b", "c", None])) for k in range(400)] + [r_ for r_ in edge_rows()]
    docs = table(spark, rows)
    out = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
    again = mixing.mix(docs).select(*out.columns)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect()))
    got = sorted((tuple(x[n] for n in sorted(out.columns) if n != "source") for x in out.collect()), key=repr)
    want = _duck(mixing.SQL, documents=docs)
    assert len(got) == len(want)
    # columns by name: doc_id, size, source_size, taken, target; which of two equal rows is taken is open, sums are not
    assert [(*x[:3], x[4]) for x in got] == [(*x[:3], x[4]) for x in want]
    assert sum(x[3] for x in got) == sum(x[3] for x in want)
    for s in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m"), F.sum("size").alias("all")).collect():
        assert abs(s.t - s.g) <= s.m and s.g <= 2 * s["all"] + 1e-9
    assert out.where("taken > 2 * size").count() == 0
    assert mixing.mix(nothing).count() == 0
    assert sum(len(re.findall(mixing.WORD, x.text or "")) for x in mixing.mixed_documents(docs).collect()) == sum(x[3] for x in got)


def test_targets_fill_up_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40)], "source string, size long")
    found = {x.source: x.target for x in mixing.targets(sizes).collect()}
    total, weight, size = 1.5 * 1550, {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 10, "b": 1000, "c": 500, None: 40}
    want, free = {}, set(weight)
    while True:
        level = (total - sum(want.values())) / sum(weight[k] for k in free)
        over = {k for k in free if level * weight[k] > 2 * size[k]}
        if not over:
            break
        want |= {k: 2.0 * size[k] for k in over}
        free -= over
    want |= {k: level * weight[k] for k in free}
    assert found == pytest.approx(want)


# --- 3 fingerprints --------------------------------------------------------------------


def test_fingerprints(spark, nothing, edges):
    docs = table(spark, [(k, t, "en", "s") for k, (_, t, _, _) in enumerate(edge_rows())] + [(50 + k, prose(random.Random(k), 200).replace(" the ", "\n"), "en", "s") for k in range(40)])
    ordered = sorted(((x.doc_id, x.text or "") for x in docs.collect()), reverse=True)
    out = {x.doc_id: x for x in fingerprint.fingerprints(docs).collect()}
    assert len(out) == len(ordered)
    for k, (i, text) in enumerate(ordered):
        following, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert out[i].n_chars == len(text) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    by_text = {}
    for i, text in ordered:
        assert by_text.setdefault(text, out[i].fingerprint) == out[i].fingerprint
    assert len(set(by_text.values())) == len(by_text)
    prose_rows = [out[k] for k in range(50, 90)]
    assert np.mean([x.near_edited for x in prose_rows]) > np.mean([x.near_next for x in prose_rows]) + 0.25
    assert fingerprint.fingerprints(nothing).count() == 0
    assert fingerprint.fingerprints(edges).count() == len(edge_rows())
    one = fingerprint.fingerprints(table(spark, [(9, "abcd", "en", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == pytest.approx(1.0)


def test_fingerprints_ignore_order_and_add_up(spark):
    def vector(text):
        df = spark.createDataFrame([(text,)], "t string").select(F.explode(fingerprint.pieces(F.col("t"))).alias("p"))
        sums = df.agg(*[F.sum(x).alias(f"v{k}") for k, x in enumerate(fingerprint.packed_bits(F.col("p"), F.lit(True)))])
        return list(sums.first())

    a, b = "one two\nthree four\n", "five six\nseven\n"
    assert vector(a + b) == vector(b + a) != vector(a)
    row = spark.createDataFrame([(vector(a), vector(b), vector(a + b))], "a array<long>, b array<long>, ab array<long>")
    x = row.select(fingerprint.add(F.col("a"), F.col("b")).alias("added"), fingerprint.subtract(F.col("ab"), F.col("b")).alias("left"), "a", "ab").first()
    assert x.added == x.ab and x.left == x.a


# --- 4 toxicity ------------------------------------------------------------------------


def test_toxicity(spark, edges, nothing):
    r = random.Random(2)
    rows, labels = [], []
    for k in range(700):
        toxic = r.random() < 0.3
        w = prose(r, 40).split()
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(["vilestuff", "grimword"]) + r.choice(["", "er", "est"])
        rows.append((k, " ".join(w), r.choice(["en", "de", None]), "s"))
        labels.append((k, 1 - int(toxic), int(toxic)))
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs), marks)
    found = toxicity.score(docs, model).join(marks, "doc_id").where(fold(3) == 1).collect()
    assert sum(x.predicted == x.toxic for x in found) > 0.95 * len(found)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in found)
    out = toxicity.score(edges, model).collect()
    assert len(out) == len(edge_rows()) and all(x.predicted == 0 for x in out if not (x.text or "").strip())
    assert toxicity.fit(docs, marks.limit(0)) is None
    assert {x.score for x in toxicity.score(edges, None).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0


def test_cnn_responses_stay_inside_texts():
    net = cnn.init(0, [np.zeros(cnn.BUCKETS)])
    ids = np.arange(7)[:, None]
    whole = cnn.responses(net, ids, np.array([0, 3, 7]))
    apart = np.concatenate([cnn.responses(net, ids[:3], np.array([0, 3])), cnn.responses(net, ids[3:], np.array([0, 4]))])
    assert np.allclose(whole, apart, atol=1e-6)


# --- 5 personal data -------------------------------------------------------------------

_KINDS = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain(text):
    out = []
    for kind, pattern in _KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@given(st.lists(st.sampled_from(["a", ".", "@", "-", "b1", " ", "9", "4111111111111111", "1.2.3.4", "+1 (017) 555-7713", "x@y.z", "256", "é", "\n", "%"]), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_match_plain_regular_expressions(text):
    assert pii.base_spans(text) == _plain(text)


def test_bootstrapping_finds_unseen_identifiers(spark, edges, nothing):
    r = random.Random(8)
    rows = [(k, f"{prose(r, 12)} customer card number: {c} is stored {prose(r, 9)}", "en", "s") for k, c in enumerate(["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "4012888888881881", "378282246310005", "6011111111111117"] * 2)]
    rows += [(100, "customer card number: 4111111111111112 is stored", "en", "s"), (101, f"{prose(r, 8)} 4111111111111112 {prose(r, 8)}", "en", "s")]
    out = {x.doc_id: x for x in pii.extract(table(spark, rows)).collect()}
    assert out[100].n_card == 0 and out[100].spans == "card:22:38" and out[101].spans == ""
    assert (out[0].n_email, out[0].n_ip, out[0].n_card, out[0].n_phone, out[0].n_added) == (0, 0, 1, 0, 0) and out[0].base_sha256 == hashlib.sha256(out[0].spans.encode()).hexdigest()
    found = pii.extract(edges).collect()
    assert len(found) == len(edge_rows()) and {x.base_sha256 for x in found} == {hashlib.sha256(b"").hexdigest()}
    assert pii.extract(nothing).count() == 0


# --- 6 similarity join -------------------------------------------------------------------


def _near_texts():
    r = random.Random(11)
    texts = [prose(r, 60) for _ in range(60)]
    base = prose(r, 80).split()
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed" + str(r.randrange(9))
        texts.append(" ".join(w))
    return texts + [texts[0]] * 9 + ["", None, "four words only here", "four words only here", "one", "  "]


@pytest.mark.parametrize("block", [512, 7])
def test_join_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = _near_texts()
    links, parent = Counter(), list(range(len(texts)))
    for i, j in pairs_of(texts):
        links[i] += 1
        links[j] += 1
    for _ in texts:
        for i, j in pairs_of(texts):
            parent[i] = parent[j] = min(parent[i], parent[j])
    docs = table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    found = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.similar_documents(docs).collect()}
    assert found == {k: (parent[k], links[k]) for k in range(len(texts))}
    kept = {x.doc_id for x in jaccard.deduplicate(docs).collect()}
    assert kept == set(parent)


def test_join_edges(spark, edges, nothing):
    assert jaccard.similar_documents(nothing).count() == 0
    out = jaccard.deduplicate(edges)
    assert out.columns == edges.columns
    assert Counter(x.text for x in out.collect())["twice the same row of words"] == 1
    assert out.count() == len(edge_rows()) - 1


def test_pruning_bound():
    for seen, least in zip(range(32, 129, 32), jaccard._LEAST, strict=True):
        assert jaccard.least_matches(seen) == least < 0.8 * seen
        # a pair at the threshold is very unlikely to be dropped
        assert sum(math.comb(seen, k) * 0.8**k * 0.2 ** (seen - k) for k in range(least)) < 2e-3


# --- 7 language model ----------------------------------------------------------------------


def test_forward_is_the_sum_over_paths():
    r = np.random.default_rng(4)
    share = lambda x: x / x.sum(axis=1, keepdims=True)
    m = hmm.Model(share(r.random((2, hmm.STATES))), share(r.random((hmm.STATES, hmm.STATES))), share(r.random((hmm.STATES, hmm.WORDS + hmm.SHAPES))))
    text = r.integers(0, 5000, 4)
    total = 0.0
    for path in itertools.product(range(hmm.STATES), repeat=4):
        p = m.start[0, path[0]]
        for t, s in enumerate(path):
            p *= (m.move[path[t - 1], s] if t else 1) * m.emit[s, text[t]]
        total += p
    assert hmm.forward(m, [text, text[:1]])[0] == pytest.approx(math.log10(total))


def test_baum_welch_never_loses_likelihood():
    r = np.random.default_rng(6)
    texts = [r.integers(0, 40, int(n)) for n in r.integers(1, 400, 40)]
    symbols, lengths, begins = hmm.segments(texts)
    m = hmm.maximised(np.ones((2, hmm.STATES)), np.ones((hmm.STATES, hmm.STATES)), r.random((hmm.STATES, hmm.WORDS + hmm.SHAPES)))
    seen = []
    for _ in range(6):
        starts, moves, emissions, likelihood = hmm.expected(m, symbols, lengths, begins)
        assert emissions.sum() == pytest.approx(sum(map(len, texts)))
        seen.append(likelihood)
        m = hmm.maximised(starts, moves, emissions)
    assert seen[-1] > seen[0]


def test_lm_scores(spark, edges, nothing):
    r = random.Random(9)
    kinds = (("aa", "bb", "cc", "dd"), ("xx", "yy", "zz", "ww"))
    rows = [(k, prose(r, r.randint(5, 300), kinds[k % 2]), "en", "s") for k in range(200)] + edge_rows()
    docs = table(spark, [(k, t, lang, s) for k, (_, t, lang, s) in enumerate(rows)])
    out = {x.doc_id: x for x in hmm.score(docs, fold(7) == 2).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for k, (_, t, _, _) in enumerate(rows)}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    count = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(count.values()), len(count)
    for k, ws in tokens.items():
        x = out[k]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(ws), sum(w in count for w in ws), n, held[k])
        assert x.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    both = [(x.score, x.base_score) for x in out.values() if x.held_out and x.n_tokens > 20]
    assert sum(a for a, _ in both) > sum(b for _, b in both)
    assert hmm.score(nothing, fold(7) == 2).count() == 0
    assert hmm.score(edges, F.lit(True)).where("base_score = 0 and n_known = 0").count() == len(edge_rows())


# --- 8 licences ------------------------------------------------------------------------------


def test_license_scan(spark, edges, nothing):
    r = random.Random(12)
    plain = [(1000 + k, "\n".join(prose(r, 30) for _ in range(3)), "en", "s") for k in range(60)]
    rows = [(k, f"{prose(r, 20)}\n{notice}\n{prose(r, 20)}", "en", "s") for k, notice in enumerate(t for ts in license.TEMPLATES.values() for t in ts)]
    teasers = [(900, "The license of the driver, version 2.0, was granted in general.", "en", "s"), (901, "public software terms the and of permission", "en", "s")]
    docs = table(spark, plain + rows + teasers)
    model = license.fit(docs)
    out = {x.doc_id: x for x in license.scan(docs, model).collect()}
    want = [f for f, ts in license.TEMPLATES.items() for _ in ts]
    assert [out[k].license for k in range(len(want))] == want
    assert all(out[i].license is None for i, _, _, _ in plain + teasers)
    assert license.scan(edges, model).count() == len(edge_rows()) and license.scan(nothing, model).count() == 0


@pytest.mark.parametrize("size", [300, 1000, 10_000])
def test_license_notice_inside_one_long_line(spark, size):
    r = random.Random(size)
    common = ["the", "in", "of", "is", "with", "to", "and", "a", "this", "for", "use", "by"]
    say = lambda n: " ".join(r.choice(common) if r.random() < 0.45 else prose(r, 1) for _ in range(n))
    notices = [(f, t) for f, ts in license.TEMPLATES.items() for t in ts]
    rows = []
    for k, (_, notice) in enumerate(notices):
        before = r.randint(0, size)
        rows.append((k, f"{say(before)} {notice} {say(size - before)}", "en", "s"))
    plain = [(1000 + k, say(size), "en", "s") for k in range(30)]
    both = [(2000, f"{notices[0][1]} {say(size)} {license.TEMPLATES['MIT'][2]} {say(size)}", "en", "s")]
    docs = table(spark, rows + plain + both)
    out = {x.doc_id: x for x in license.scan(docs, license.fit(docs)).collect()}
    assert sum(out[k].license == f for k, (f, _) in enumerate(notices)) >= len(notices) - 1
    assert sum((out[k].families, out[k].n_confirmed) == (f, 1) for k, (f, _) in enumerate(notices)) >= len(notices) - 1
    assert all(out[i].license is None for i, _, _, _ in plain)
    assert out[2000].families == "AGPL-3.0,MIT" and out[2000].n_confirmed == 2


def test_license_wrapped_notices(spark):
    r = random.Random(14)
    notices = [(f, t) for f, ts in license.TEMPLATES.items() for t in ts]
    rows = []
    for width, lead in ((72, ""), (78, " * "), (72, "# "), (40, "// ")):
        for f, notice in notices:
            wrapped = textwrap.wrap(f"{prose(r, 12)}. {notice}", width, initial_indent=lead, subsequent_indent=lead)
            text = "\n".join([prose(r, 30), "", *wrapped, lead.rstrip(), lead + prose(r, 8), "", prose(r, 30)])
            rows.append((len(rows), text if len(rows) % 2 else text.replace("\n", "\r\n"), f, "s"))
    plain = [(1000 + k, "\n".join(textwrap.wrap(prose(r, 200), 72)), "en", "s") for k in range(60)]
    docs = table(spark, rows + plain)
    out = {x.doc_id: x for x in license.scan(docs, license.fit(docs)).collect()}
    assert sum(out[k].families == f and out[k].n_confirmed == 1 for k, _, f, _ in rows) >= 0.98 * len(rows)
    assert all(out[i].license is None for i, _, _, _ in plain)


def test_license_notices_on_neighbouring_lines(spark):
    assert all(re.search(license.NAMES, t) for ts in license.TEMPLATES.values() for t in ts)
    r = random.Random(15)
    few = {f: license.TEMPLATES[f][0] for f in ("MIT", "Apache-2.0", "ISC", "MPL-2.0")}
    rows = [(k, "\n".join([prose(r, 12), *few.values(), prose(r, 12)]), "en", "s") for k in range(5)]
    plain = [(1000 + k, "\n".join(prose(r, 30) for _ in range(3)), "en", "s") for k in range(60)]
    docs = table(spark, rows + plain)
    out = {x.doc_id: x for x in license.scan(docs, license.fit(docs)).collect()}
    assert {out[k].families for k in range(5)} == {",".join(sorted(few))}
    assert all(out[i].license is None for i, _, _, _ in plain)


# --- 9 token store ----------------------------------------------------------------------------


def test_store_round_trip(spark, edges, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = tokenstore.default_tokenizer()
    plain = Tokenizer.from_file(path)
    hard = ["a  b", "a <|endoftext|> b", "x\n y", " lead", "trail ", "  x", "don't  stop 123 !! ...", "", "a\0b c", "tab\tx y", "   ", "é ñ 日本 語", None, prose(random.Random(1), 5000)]
    docs = table(spark, [(k, t, "en", "s") for k, t in enumerate(hard * 3)])
    where = f"file://{tmp_path}/store"
    tokenstore.write(docs, where, path)
    out = {x.doc_id: x for x in tokenstore.read(spark, where).collect()}
    start = 0
    for k, t in enumerate(hard * 3):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (out[k].start, out[k].n_tokens, out[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert spark.read.parquet(f"{where}/chunks").count() <= spark.read.parquet(f"{where}/recipes").select(F.explode("chunks")).count() // 3 + 1
    # a chunk that was changed is found
    rows = spark.read.parquet(f"{where}/chunks").collect()
    broken = [(r.hash, r.n_ids, bytes([*r.ids[:-1], r.ids[-1] ^ 1]) if k == 0 else r.ids) for k, r in enumerate(rows)]
    spark.createDataFrame(broken, "hash binary, n_ids int, ids binary").write.mode("overwrite").parquet(f"{where}/chunks")
    with pytest.raises(Exception, match="doesn't match"):
        tokenstore.read(spark, where).collect()
    for name, df in (("edges", edges), ("nothing", nothing)):
        tokenstore.write(df, f"file://{tmp_path}/{name}", path)
        assert tokenstore.read(spark, f"file://{tmp_path}/{name}").count() == df.count()


@given(st.lists(st.lists(st.integers(0, 60_000), max_size=9), max_size=5))
@settings(max_examples=60, deadline=None)
def test_joined_crc(parts):
    crcs = np.array([zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts], np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)
    whole = zlib.crc32(np.array([i for p in parts for i in p], "<u4").tobytes())
    assert tokenstore.joined_crc(crcs, sizes, np.array([0, len(parts)])).tolist() == [whole]


def test_cuts_depend_on_content_alone():
    r = np.random.default_rng(2)
    body = r.integers(0, 50_000, 20_000).astype(np.uint32)
    one = tokenstore.cuts(body, np.array([0, len(body)]))[0]
    shifted = np.concatenate([np.arange(777, dtype=np.uint32), body])
    two = [e - 777 for e in tokenstore.cuts(shifted, np.array([0, len(shifted)]))[0]]
    assert len(set(one) & set(two)) > 0.8 * len(one)
    sizes = np.diff([0, *one])
    assert sizes.max() <= tokenstore.MOST and sizes[:-1].min() >= tokenstore.LEAST


# --- 10 decontamination -------------------------------------------------------------------------


def _distance_to_passage(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (v != w)))
        row = new
    return min(row)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), max_size=14))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_edit_distance(item, text):
    assert decontam.edits_within(item, text, 99) == _distance_to_passage(item, text)


def test_decontamination_recall(spark, edges, nothing):
    r = random.Random(21)
    stems = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    say = lambda n: [r.choice(stems) + r.choice(stems) for _ in range(n)]
    items = [say(r.randint(12, 50)) for _ in range(40)] + [[]]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    rows, want = [], set()
    for k in range(240):
        w = list(items[k % 40])
        for _ in range(r.randint(0, int(0.2 * len(w)))):
            kind, at = r.randrange(3), r.randrange(len(w))
            if kind == 0:
                w[at] = "".join(say(1)) + "x"
            elif kind == 1:
                del w[at]
            else:
                w.insert(at, "".join(say(1)) + "y")
        rows.append((k, " ".join(say(40)).capitalize() + ". " + " ".join(w).upper() + ", " + " ".join(say(40)), "en", "s"))
        want.add((k, k % 40))
    rows += [(1000 + k, " ".join(say(200)), "en", "s") for k in range(40)]
    docs = table(spark, rows)
    found = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()}
    assert len(want & found) >= 0.98 * len(want)
    assert found <= want
    clean = {x.doc_id for x in decontam.clean(docs, bench).collect()}
    assert clean == {i for i, _, _, _ in rows} - {d for d, _ in found}
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.clean(edges, bench).count() == len(edge_rows())


@pytest.mark.parametrize("even", [False, True])
def test_decontamination_of_long_items(even):
    r = random.Random(22)
    stems = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    say = lambda n: [r.choice(stems) + r.choice(stems) for _ in range(n)]
    items = [say(n) for n in (150, 200, 300, 400, 600) for _ in range(4)]
    index = decontam.build(list(range(len(items))), [" ".join(w) for w in items])
    texts, want = [], set()
    for k in range(100):
        w = list(items[k % 20])
        edits = int(0.2 * len(w))
        for at in [int((j + 0.5) * len(w) / edits) for j in reversed(range(edits))] if even else [None] * edits:
            kind, at = r.randrange(3), r.randrange(len(w)) if at is None else at
            w[at : at + (kind < 2)] = [] if kind == 1 else ["x" + str(r.randrange(10**6))]
        want.add((k, k % 20))
        texts.append(" ".join(say(r.randrange(60)) + w + say(r.randrange(60))))
    texts += [" ".join(say(1500)) for _ in range(40)]
    found = decontam.search(index, *buffers(pa.array(texts)))
    assert {(d, i) for d, i, _ in found} == want
    hashes = lambda t: decontam.words(*buffers(pa.array([t])), decontam.ALNUM).hash.tolist()
    for d, i, edits in found[::10]:
        assert edits == decontam.edits_within(hashes(" ".join(items[i])), hashes(texts[d]), 10**6)


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(31)
    items = [prose(r, 20) for _ in range(5)]
    rows = [(k, prose(r, 50), "en", "ab"[k % 2]) for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "a") for k in range(10)] + [(200, items[0] + " " + prose(r, 30), "en", "a"), (201, "12 34", "en", "a"), (202, None, None, None)]
    folder = f"{tmp_path}/data"
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    kept = {i for i, _, _, _ in rows} - set(range(100, 110)) - {200, 201, 202}
    assert {x.doc_id for x in out} <= kept and len({x.doc_id for x in out}) > 0.6 * len(kept)
    total = sum(len(t.split()) for i, t, _, _ in rows if i in kept)
    words_of = {i: len(t.split()) for i, t, _, _ in rows if t}
    assert abs(sum(words_of[x.doc_id] for x in out) - 1.5 * total) < 120
    assert max(Counter(x.doc_id for x in out).values()) <= 2
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


# --- large, hot and odd inputs ------------------------------------------------------------------------


def test_fingerprint_of_very_many_pieces_and_text_ids(spark, monkeypatch):
    rows = [("a", "x\n" * 2_100_000), ("b", "hello"), (None, "q w e"), ("", "z"), ("c", None)]
    out = {x.doc_id: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    # descending ids, null last: c, b, a, '', null
    edited = {"c": "", "b": "helx\n"[:5], "a": "x\n" * 1_050_000 + "z", "": "z"[:1], None: "q w"}
    assert out["a"].n_chars == 4_200_000 and out["a"].near_edited == pytest.approx(0.8, abs=0.01)
    assert out["a"].fingerprint.startswith(hex(2_100_000)[2:])
    for k in ("c", "b", "a", ""):
        assert out[k].edited_sha256 == hashlib.sha256(edited[k].encode()).hexdigest(), k
    # sums of runs are those of whole texts
    many = spark.createDataFrame([(k, prose(random.Random(k), 300)) for k in range(6)], "doc_id long, text string")
    whole = sorted(map(tuple, fingerprint.fingerprints(many).collect()))
    monkeypatch.setattr(fingerprint, "RUN", 4)
    assert sorted(map(tuple, fingerprint.fingerprints(many).collect())) == whole


def test_likeness_against_shared_pieces(spark):
    r = random.Random(17)
    lines = [prose(r, 6) for _ in range(60)]
    rows = [(10, "\n".join(lines[:40]) + "\n"), (9, "\n".join(lines[20:60]) + "\n"), (8, prose(r, 200).replace(" the ", "\n"))]
    out = {x.doc_id: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = spark.createDataFrame(rows, "doc_id long, text string").select("text", fingerprint.pieces(F.col("text")).alias("pieces")).collect()
    assert all("".join(x.pieces) == x.text for x in cut)
    pieces = lambda t: next(Counter(x.pieces) for x in cut if x.text == t)
    texts = dict(rows)
    for one, other in ((10, 9), (9, 8)):
        a, b = pieces(texts[one]), pieces(texts[other])
        shared = 2 * sum(a[p] * b[p] for p in a) / (sum(v * v for v in a.values()) + sum(v * v for v in b.values()))
        assert out[one].near_next == pytest.approx(shared, abs=0.2)


def test_license_repeated_rows_and_whole_headers(spark):
    r = random.Random(18)
    plain = [(1000 + k, "\n".join(prose(r, 30) for _ in range(3)), "en", "s") for k in range(60)]
    one = f"{prose(r, 20)}\n\n{license.TEMPLATES['ISC'][0]}\n\n{prose(r, 20)}"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    wrapped = [(10 + k, "\n".join(["Copyright (C) someone", "", *textwrap.wrap(t, 72), "", prose(r, 40)]), "en", "s") for k, t in enumerate((mit, gpl))]
    docs = table(spark, plain + [(1, one, "en", "s"), (2, one, "en", "s"), (2, one, "en", "s"), (2, one, "en", "s")] + wrapped)
    model = license.fit(docs)
    out = license.scan(docs, model).collect()
    assert len(out) == len(plain) + 6
    found = [(x.license, x.probability, x.n_confirmed) for x in out if x.doc_id in (1, 2)]
    assert len(found) == 4 and {(a, n) for a, _, n in found} == {("ISC", 1)}
    assert max(p for _, p, _ in found) - min(p for _, p, _ in found) < 1e-12
    assert {x.doc_id: x.license for x in out if x.doc_id in (10, 11)} == {10: "MIT", 11: "GPL-3.0"}


def test_counts_beyond_32_bits():
    known = np.sort(np.array([5, 9], np.uint64))
    rows = {"block": [1, 2], "bucket": [0, 0], "data": [known.astype("<u8").tobytes()] * 2, "counts": [np.array([3_000_000_000, 1], "<i8").tobytes()] * 2}
    out = hmm._returned(pa.table(rows))
    assert np.frombuffer(out["data"][0].as_py(), "<i8").tolist() == [6_000_000_000, 2]


def test_lm_counts_by_groups_of_blocks(spark, monkeypatch):
    r = random.Random(19)
    docs = table(spark, [(k, prose(r, r.randint(1, 80)), "en", "s") for k in range(120)] + [(500, prose(r, 3000), "en", "s")])
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    plain = sorted(map(tuple, hmm.score(docs, fold(7) == 2).select(*names).collect()))
    for name, value in (("BLOCK_BYTES", 500), ("BUCKET_DOCS", 3), ("GROUP", 2), ("FACTS", 3), ("MOST_ROWS", 2)):
        monkeypatch.setattr(hmm, name, value)
    split = sorted(map(tuple, hmm.score(docs, fold(7) == 2).select(*names).collect()))
    assert [x[:4] for x in split] == [x[:4] for x in plain] and [x[4] for x in split] == pytest.approx([x[4] for x in plain])


def test_forward_of_a_long_text(monkeypatch):
    r = np.random.default_rng(5)
    share = lambda x: x / x.sum(axis=1, keepdims=True)
    m = hmm.Model(share(r.random((2, hmm.STATES))), share(r.random((hmm.STATES, hmm.STATES))), share(r.random((hmm.STATES, hmm.WORDS + hmm.SHAPES))))
    texts = [r.integers(0, 5000, n) for n in (1, 2, 511, 512, 513, 514, 1025, 5000)]
    plain = hmm.forward(m, texts)
    monkeypatch.setattr(hmm, "LONG", 0)
    assert hmm.forward(m, texts) == pytest.approx(plain)


def test_every_language_is_learned_from(spark):
    rows = [(k, "some text here", f"l{k % 300:03}", "s") for k in range(900)]
    sampled = langid.sample_by(table(spark, rows), "lang", 2)
    assert sampled.select("lang").distinct().count() == 300 and sampled.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_goes_by_the_model(spark):
    r = random.Random(20)
    kinds = {"en": ("the", "ing", "and", "th"), "fr": ("é", "eau", "le", "qu"), "de": ("sch", "ü", "ei", "der")}
    rows = [(k, prose(r, r.randint(20, 60), kinds[lang]), lang, "s") for k, lang in zip(range(300), itertools.cycle(kinds), strict=False)]
    strange = [(1000, "это русский текст о погоде и природе " * 8, None, "s"), (1001, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)), None, "s")]
    wrong = [(1002, prose(r, 80, kinds["de"]), "en", "s")]
    docs = table(spark, rows + strange + wrong + [(1003, "12 34", "en", "s"), (1004, None, "en", "s")]).withColumn("score", F.lit("own"))
    model = langid.fit(docs.where("doc_id < 1000"))
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {x.score for x in kept.collect()} == {"own"}
    assert {x.doc_id for x in kept.collect()} == {k for k, _, _, _ in rows}
    # nothing but letters can decide where nothing was learned
    assert langid.accepted(docs, None).count() == len(rows) + 3


def test_inclusion_frequencies(spark):
    r = random.Random(23)
    sizes = spark.createDataFrame([(k, k, "ab"[k % 2], r.choice([1, 5, 30, 200])) for k in range(120)], "row long, doc_id long, source string, size long")
    of = {(x.source, x.weight): x.chance for x in mixing.inclusion(sizes, mixing.targets(sizes)).collect()}
    assert len(set(of.values())) > 3 and all(0 <= p <= 1 for p in of.values())
    rounds, seen = 24, Counter()
    for salt in range(rounds):
        for x in mixing.take(sizes, f"s{salt}:").collect():
            seen[x.source, len(bin(x.size)) - 2] += x.copies - int(x.target / x.source_size)
    members = Counter((x.source, len(bin(x.size)) - 2) for x in sizes.collect())
    for key, p in of.items():
        assert seen[key] / rounds / members[key] == pytest.approx(p, abs=0.12), key


def test_mixed_documents_keep_any_columns(spark, edges):
    docs = edges.withColumns({"__row": F.lit("mine"), "copies": F.lit(9), "size": F.lit("s"), "source_size": F.lit(0), "own1": F.lit(1)})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {x["__row"] for x in out.collect()} == {"mine"}


def test_secrets_and_patterns_without_seeds(spark):
    r = random.Random(24)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'{prose(r, 10)} token = "{key()}"### {prose(r, 8)}', "en", "s") for k in range(12)]
    odds = [f"Qw{k}ertZu{k}iopAs{k}9" for k in range(7)]
    odd = odds[6]
    rows += [(100, f'{prose(r, 5)} token = "{odd}" {prose(r, 5)}', "en", "s"), (101, f"{prose(r, 5)} commit {key()} {prose(r, 5)}", "en", "s")]
    # the odd key is believed by its label, and speaks for another label in turn
    rows += [(200 + k, f"{prose(r, 5)} passphrase: {odds[k]} {prose(r, 5)}", "en", "s") for k in range(6)]
    rows += [(300 + k, f'{prose(r, 5)} token = "{odds[k]}" {prose(r, 5)}', "en", "s") for k in range(6)]
    rows += [(400, f"{prose(r, 5)} passphrase: another9secret8value7 {prose(r, 5)}", "en", "s")]
    out = {x.doc_id: x for x in pii.extract(table(spark, rows)).collect()}
    assert all(out[k].n_secret == 1 and out[k].n_found == 1 for k in (*range(12), 100, 400))
    start = rows[12][1].index(odd)
    assert out[100].secret_spans == out[100].spans == f"secret:{start}:{start + len(odd)}"
    assert out[101].n_secret == 0
    long = " ".join(f"{k}.1.2.3" for k in range(60_000))
    assert pii.extract(table(spark, [(1, long, "en", "s")])).first().n_ip == 256


def test_components_of_a_chain_and_a_hub(spark, monkeypatch):
    from stockloom.llm import common, graph

    monkeypatch.setattr(common, "HEAVY", 50)
    chain = spark.range(100_000).select(((F.col("id") * 7919) % 100_003).alias("u"), (((F.col("id") + 1) * 7919) % 100_003).alias("v"))
    hub = spark.range(3000).select(F.lit(200_000).cast("long").alias("u"), (F.col("id") + 200_001).alias("v"))
    found = graph.components(chain.unionByName(hub))
    sizes = {x["root"]: x["n"] for x in found.groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert sizes[200_000] == 3001 and sizes[0] == 100_001 and len(sizes) == 2


def test_units_with_equal_hashes_are_encoded_apart(monkeypatch):
    path = tokenstore.default_tokenizer()
    with open(path, encoding="utf-8") as f:
        encoder = tokenstore.Encoder(f.read())
    monkeypatch.setattr(tokenstore, "span_hashes", lambda data, start, ends, lower: [data[start].astype(np.uint64) for _ in ends])
    texts = ["one two three four", "one tiny thing flew", "four two three tied", "", "plain"]
    ids, first = encoder.encode(*buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_store_notices_changes_and_takes_text_ids(spark, tmp_path):
    path = tokenstore.default_tokenizer()
    docs = spark.createDataFrame([(f"d{k:03}", prose(random.Random(k), 50)) for k in range(40)], "doc_id string, text string")

    def change(part, do):
        where = f"file://{tmp_path}/{part}-{do.__name__}"
        tokenstore.write(docs, where, path)
        rows = do(spark.read.parquet(f"{where}/{part}"))
        schema = rows.schema
        rows = spark.createDataFrame(rows.collect(), schema)
        rows.write.mode("overwrite").parquet(f"{where}/{part}")
        with pytest.raises(Exception, match="doesn't match"):
            tokenstore.read(spark, where).collect()

    where = f"file://{tmp_path}/whole"
    tokenstore.write(docs, where, path)
    out = sorted(tokenstore.read(spark, where).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in out] == [f"d{k:03}" for k in range(40)]

    def other_count(df):
        return df.withColumn("n_tokens", F.col("n_tokens") + 1)

    def fewer(df):
        return df.where("place > 1")

    def none(df):
        return df.limit(0)

    def swapped(df):
        return df.withColumn("chunks", F.reverse(F.concat("chunks", "chunks")))

    change("manifest", other_count)
    for do in (other_count, fewer, swapped):
        change("recipes", do)


def test_decontamination_against_all_windows(spark):
    r = random.Random(25)
    stems = [a + b for a in "bcdfgk" for b in "aeiou"]
    say = lambda n: [r.choice(stems) for _ in range(n)]
    items = [say(r.randint(4, 30)) for _ in range(25)]
    rows = []
    for k in range(120):
        w = say(r.randint(0, 60))
        if k % 3 == 0:
            part = list(r.choice(items))
            for _ in range(r.randint(0, 8)):
                part[r.randrange(len(part))] = r.choice(stems)
            w[10:10] = part
        rows.append((k, " ".join(w), "en", "s"))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    want = {(d, i): e for d, t, _, _ in rows for i, w in enumerate(items) if (e := _distance_to_passage(w, t.split())) <= int(decontam.EDITS * len(w))}
    got = {(x.doc_id, x.item_id): x.edits for x in decontam.contaminated(table(spark, rows), bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(e >= want[k] for k, e in got.items())


@pytest.mark.parametrize("size", [400, 800])
def test_decontamination_at_the_full_distance(size):
    r = random.Random(size)
    stems = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    say = lambda n: [r.choice(stems) + r.choice(stems) for _ in range(n)]
    items = [say(size) for _ in range(5)]
    index = decontam.build(list(range(5)), [" ".join(w) for w in items])
    texts = []
    for k in range(50):
        w = list(items[k % 5])
        for at in r.sample(range(size), int(0.2 * size)):
            w[at] = "x" + str(r.randrange(10**6))
        texts.append(" ".join(say(30) + w + say(30)))
    found = {(d, i) for d, i, _ in decontam.search(index, *buffers(pa.array(texts)))}
    assert len(found & {(k, k % 5) for k in range(50)}) >= 49
