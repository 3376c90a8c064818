"""Band join, fill-in-middle and sharding against brute force, and on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stockloom.llm import band, fim, sharding

DOCS = "doc_id long, text string"


# --- band join ---------------------------------------------------------------

def brute_band(points, rows, nearest, b):
    out = []
    for key, p in points:
        pairs = []
        for own, u, sale, line, crc in rows:
            if p is None or own is None or u is None or own == key:
                continue
            gap = abs(u - p)
            if gap <= b.absolute or b.whole * gap <= b.part * max(u, p):
                pairs.append((gap, u, sale, line, own, crc))
        pairs.sort(key=lambda x: x[:5])
        told = (len(pairs), sum(x[0] for x in pairs), sum(x[5] for x in pairs))
        out += [(key, k + 1, *x[:5], *told) for k, x in enumerate(pairs[:nearest])] or [(key, 0, *[None] * 5, *told)]
    return sorted(out, key=repr)


def joined(spark, points, rows, nearest=2, b=band.Band()):  # noqa: B008
    points = spark.createDataFrame(points, "key long, p long")
    rows = spark.createDataFrame(rows, "key long, u long, sale_id long, line_no int, crc long")
    out = band.band_join(points, rows, nearest, b)
    return sorted(map(tuple, out.select("key", "rank", "gap", "u", "sale_id", "line_no", "row_key", "n_pairs", "gap_sum", "checksum").collect()), key=repr)


@pytest.mark.parametrize(("seed", "nearest", "b"), [(1, 2, band.Band()), (2, 1, band.Band(3, 1, 10)), (3, 4, band.Band(0, 1, 50)), (4, 3, band.Band(25, 9, 10))])
def test_band_join_is_brute_force(spark, seed, nearest, b):
    r = random.Random(seed)
    # few keys and values, so that ties, repeated rows and runs of own rows are many
    rows = [(r.randrange(6), r.randrange(-20, 400) * r.choice((1, 1, 7)), r.randrange(9), r.randrange(3), r.randrange(1 << 32)) for _ in range(400)]
    rows += rows[:40] + [(5, 100, k, 0, k) for k in range(120)]
    points = [(r.choice((0, 1, 2, 3, 4, 5, 77, None)), r.choice((None, r.randrange(-30, 3000)))) for _ in range(80)] + [(5, 100)] * 7 + [(5, 101), (77, 10**12)]
    assert joined(spark, points, rows, nearest, b) == brute_band(points, rows, nearest, b)


def test_band_join_steps_over_a_run_of_own_rows(spark):
    """Nearest rows of another key lie behind thousands of the point's own."""
    rows = [(1, 1000 + k % 90, k, 0, 1) for k in range(3000)] + [(2, 1095, 1, 1, 5), (3, 905, 2, 1, 6), (2, 1096, 3, 1, 7)]
    points = [(1, 1000), (2, 1000), (3, 1000)]
    assert joined(spark, points, rows) == brute_band(points, rows, 2, band.Band())


def test_band_join_of_many_equal_points(spark):
    found = joined(spark, [(1, 500)] * 2500, [(2, 501, 1, 1, 9)])
    assert Counter(found) == {(1, 1, 1, 501, 1, 1, 2, 1, 1, 9): 2500}


def test_band_join_of_empty_tables(spark):
    assert joined(spark, [], [(1, 1, 1, 1, 1)]) == []
    assert joined(spark, [(1, 5), (None, None)], []) == [(1, 0, None, None, None, None, None, 0, 0, 0), (None, 0, None, None, None, None, None, 0, 0, 0)]


def test_unit_prices(spark):
    kind = "item_id long, sale_id long, line_no int, quantity int, amount double, u string, key string"
    rows = [
        (1, 2, 3, 3, 1.0, "x", "y"), (1, 2, None, 2, 0.01, "x", "y"), (1, 2, 3, -4, 1.0, None, None), (1, 2, 3, 0, 1.0, None, None), (None, 2, 3, 1, 1.0, None, None), (1, None, 3, 1, 1.0, None, None),
        (1, 2, 3, None, 1.0, None, None), (1, 2, 3, 1, None, None, None), (1, 2, 3, 1, math.nan, None, None), (1, 2, 3, 1, math.inf, None, None), (1, 2, 3, 1, -2.345, None, None),
    ]
    found = band.unit_prices(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.u, r.line_no is None) for r in found) == sorted([(33, False), (1, True), (-25, False), (math.floor(100 * -2.345 + 0.5), False)])
    assert {r.crc for r in found} == {zlib.crc32(b"2,3,1"), zlib.crc32(b"2,,1")}
    prices = spark.createDataFrame([(1, 2.675), (2, None), (3, math.nan), (4, 1e300)], "item_id long, price double")
    assert {r.key: r.p for r in band.priced(prices).collect()} == {1: math.floor(100 * 2.675 + 0.5), 2: None, 3: None, 4: None}


def test_cursors_keep_enough_for_any_key():
    r = random.Random(5)
    for _ in range(300):
        parts = [[(v, r.randrange(3), 0, r.randrange(3)) for _ in range(r.randrange(6))] for v in range(5)]
        state = []
        for part in reversed(parts):
            state = band.merged(part, state, 2)
        for key in range(4):
            assert [x for x in state if x[3] != key][:2] == [x for part in parts for x in part if x[3] != key][:2]


# --- fill in the middle ------------------------------------------------------

def brute_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    r = random.Random(9)
    pieces = ["\n", "\n\n", "a", "<", ">", "P>", "<S", "é", "日本", "\U0001f600", "\r", "\x00", " ", "\t", "'", "\\n", " ", "M", "word"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(300)]
    return [*texts, None, "", "\n", "one line", "x <P> y", "<M>", "<S>\n", "a\n" * 20_000, "w" * 300_000, "日本語\n" * 30_000]


def test_fim_is_brute_force_and_comes_back(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(None, "a\nb\nc"), (7, "the same\nid"), (7, "the same\nid")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "id": F.lit("x"), "output": F.lit("y"), "form": F.lit("z"), "n": F.lit(2)})
    out = fim.transform(docs)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((brute_fim(*r) for r in rows), key=repr)
    back = fim.restore(out)
    assert "output" not in back.columns
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((k, t or "") for k, t in rows)
    told = {(r.doc_id, r.output_sha256): r for r in fim.digests(docs).collect()}
    for doc_id, text in rows:
        whole = brute_fim(doc_id, text)
        row = told[doc_id, hashlib.sha256(whole[-1].encode()).hexdigest()]
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.restored_sha256) == (*whole[1:5], hashlib.sha256((text or "").encode()).hexdigest())
    assert {brute_fim(*r)[2] for r in rows} == {"plain", "psm", "spm"}


def test_fim_rates_and_ids_of_other_types(spark):
    rows = [(f"d{k}", f"line {k}\nmore\nlast") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = {r.doc_id: r for r in fim.transform(docs, fim.Fim(rate=40, spm=10)).collect()}
    assert {k: tuple(v) for k, v in out.items()} == {k: brute_fim(k, t, 40, 10) for k, t in rows}
    assert fim.digests(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="sentinels"):
        fim.Fim(prefix="<S>")


# --- sharding ----------------------------------------------------------------

def brute_shard(key, tree):
    def draw(name, weight):
        bits = int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2.0**52) / weight

    weigh = lambda rack: sum(w for _, w in rack)
    _, i = min((draw(f"region {i}", sum(map(weigh, r))), i) for i, r in enumerate(tree.regions) if sum(map(weigh, r)))
    _, j = min((draw(f"rack {i}.{j}", weigh(r)), j) for j, r in enumerate(tree.regions[i]) if weigh(r))
    return min((draw(f"shard {s}", w), s) for s, w in tree.regions[i][j] if w)[1]


def keys(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("key"))


def placed(spark, n, tree):
    return {r.key: (r.shard.region, r.shard.rack, r.shard.shard) for r in sharding.placed(keys(spark, n), tree, F.col("key")).collect()}


UNEVEN = sharding.Tree(((((0, 1.0), (1, 3.0)), ((2, 2.0),)), (((5, 0.5), (6, 0.0), (9, 1.5)),), (((7, 0.0),),)))


def test_shards_are_brute_force(spark):
    for tree in (sharding.even(), UNEVEN, sharding.even(1)):
        assert {k: s for k, (_, _, s) in placed(spark, 400, tree).items()} == {str(k): brute_shard(k, tree) for k in range(400)}


def test_rows_go_by_weight_and_only_changed_subtrees_move(spark):
    n = 8000
    before = placed(spark, n, UNEVEN)
    share = Counter(s for _, _, s in before.values())
    assert not share[6] and not share[7]
    for s, w in ((0, 1), (1, 3), (2, 2), (5, 0.5), (9, 1.5)):
        assert abs(share[s] - n * w / 8) < 5 * math.sqrt(n * w / 8)
    # weight moves from shard 1 to shard 2 of one region: nothing leaves it or enters, nothing moves between shards 0 and 1's old rows but away
    moved = sharding.Tree(((((0, 1.0), (1, 2.0)), ((2, 3.0),)), *UNEVEN.regions[1:]))
    after = placed(spark, n, moved)
    assert all(before[k] == after[k] for k in before if before[k][0] != 0)
    assert all(after[k][0] == 0 for k in before if before[k][0] == 0)
    assert any(before[k] != after[k] for k in before)


def test_a_new_shard_takes_rows_only_into_itself(spark):
    n = 8000
    for tree, new in ((sharding.even(), 40), (UNEVEN, 11), (sharding.even(13), 13)):
        before, after = placed(spark, n, tree), placed(spark, n, tree.grown(new))
        gone = [k for k in before if before[k] != after[k]]
        assert all(after[k][2] == new for k in gone)
        assert abs(len(gone) - n / (1 + tree.weight())) < 5 * math.sqrt(n / (1 + tree.weight()))


def test_shard_of_odd_rows(spark):
    rows = [(k, f"text {k % 7} é") for k in range(200)] + [(5, "hot")] * 300 + [(None, None)] * 3 + [(None, ""), (6, "w" * 400_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "key": F.lit("k"), "shard": F.lit(0), "range": F.lit(1), "size": F.lit(-1)})
    out = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    for s in {r.shard for r in out}:
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in out if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1:])
    assert all(r.shard == brute_shard("" if r.doc_id is None else r.doc_id, sharding.even()) and r.grown_shard in (r.shard, 40) and r.law == "key" for r in out)
    text_ids = sharding.shard(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")).collect()
    assert len(text_ids) == len(rows)
    assert sharding.shard(docs.limit(0)).collect() == []


def test_trees_that_are_none():
    with pytest.raises(ValueError, match="differ"):
        sharding.Tree(((((0, 1.0), (0, 1.0)),),))
    with pytest.raises(ValueError, match="weight"):
        sharding.Tree(((((0, 0.0),),),))
