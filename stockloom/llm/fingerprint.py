"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is cut into pieces: after every line, and within a line after words whose
hash says so, every ``PIECE_WORDS`` words in the mean. So cuts move along with
the words, and a word put in or taken out anywhere changes the piece it stands
in and no other. Each character of a script without spaces is a word. Each
piece's hashes are
spread over a wide vector of 0/1 lanes, and a document's fingerprint is the
sum of its pieces' vectors modulo powers of two. So equal texts have equal
fingerprints, the order of pieces doesn't matter, and pieces are inserted or
deleted by adding or subtracting their vectors. As lanes are independent fair
bits, the inner product of two centred sums estimates how many pieces two
documents share: likeness is 2<a,b> / (<a,a> + <b,b>), cut to 0..1.

Pieces are summed in runs of ``RUN``, in which no lane can carry into the next,
and runs are added lane by lane modulo 2**WIDTH, so a text may have any number
of pieces. Likeness is taken before lanes are reduced.

Edge cases: a null text is an empty one; an empty text has no piece, all lanes
0, and likeness 1 to another empty text. Documents are ordered by descending
id, whole numbers by value and ids of any other type by their text, null ids
last, equal ids by descending text; equal rows are separate documents. The only
document of a table is its own next one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One word in so many ends a piece, by a hash of seed CUT_SEED.
PIECE_WORDS, CUT_SEED = 8, 29
#: Han, kana and Hangul, where words have no spaces between them.
UNSPACED = r"\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
#: Whole text in words with the white space behind them (and before the first), or white space alone.
WORD = rf"\s*(?:[{UNSPACED}]|[^\s{UNSPACED}]+)[^\S\n]*\n*|\s+"
#: Stands at cuts while a text is cut; where a text has it, two others stand for it, and two for the one that begins those.
MARK, ESCAPE = "\ue000", "\ue001"
#: Hashes of a piece, and how their bits are packed: LANES lanes of WIDTH bits in a word of 64.
SEEDS, LANES, WIDTH = (11, 12), 3, 21
LANE = (1 << WIDTH) - 1
#: Pieces whose vectors are summed before lanes are reduced; below 2**WIDTH, so none carries.
RUN = 1 << (WIDTH - 1)
ROWS_OF_BLOCK, FANOUT, MOST_BLOCKS = 2048, 256, 1 << 16
#: Keys that are drawn to find where blocks of text ids end, and bits of a key's hash that decide.
SAMPLED_KEYS, DRAWN = 20_000, 1 << 30


def pieces(text: Column) -> Column:
    """The pieces of a text, in order; different texts have different ones."""
    text = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "\ue003")), F.lit(MARK), F.lit(ESCAPE + "\ue002"))
    ends = lambda word: word.contains("\n") | (F.pmod(F.xxhash64(word, F.lit(CUT_SEED)), F.lit(PIECE_WORDS)) == 0)
    marked = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda word: F.when(ends(word), F.concat(word, F.lit(MARK))).otherwise(word))
    return F.array_remove(F.split(F.array_join(marked, ""), MARK), "")


def packed_bits(piece: Column, which: Column) -> list[Column]:
    """The packed words of one piece's vector where ``which`` holds, else 0."""
    ones = sum(1 << (WIDTH * k) for k in range(LANES))
    hashes = [F.when(which, F.xxhash64(piece, F.lit(seed))).otherwise(F.lit(0).cast("long")) for seed in SEEDS]
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ones)) for h in hashes for k in range(WIDTH)]


def lanes(vector: Column) -> Column:
    """Every lane of a packed vector."""
    mask = F.lit(LANE).cast("long")
    return F.flatten(F.transform(vector, lambda x: F.array(*[F.shiftrightunsigned(x, WIDTH * k).bitwiseAND(mask) for k in range(LANES)])))


def add(one: Column, other: Column) -> Column:
    """Fingerprint of the union of two multisets, lane by lane modulo 2**WIDTH."""
    return _lanewise(one, other, lambda a, b: a + b)


def subtract(one: Column, other: Column) -> Column:
    """Fingerprint of a multiset without the pieces of another one that it holds."""
    return _lanewise(one, other, lambda a, b: a - b)


def total(vectors: Column) -> Column:
    """Sum of an array of vectors, lane by lane modulo 2**WIDTH."""
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors), F.lit(1))), F.element_at(vectors, 1), add)


def _lanewise(one: Column, other: Column, combine) -> Column:
    mask = F.lit(LANE).cast("long")

    def word(x: Column, y: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(LANES):
            a, b = (F.shiftrightunsigned(v, WIDTH * k).bitwiseAND(mask) for v in (x, y))
            out = out.bitwiseOR(F.shiftleft(combine(a, b).bitwiseAND(mask), WIDTH * k))
        return out

    return F.zip_with(one, other, word)


def lane_sums(vectors: Column) -> Column:
    """Every lane of the sum of an array of vectors, not reduced."""
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors), F.lit(1))), lanes(F.element_at(vectors, 1)), lambda s, x: F.zip_with(s, lanes(x), lambda a, b: a + b))


def _centred(sums: Column, count: Column) -> Column:
    return F.transform(sums, lambda x: (x * 2 - count).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(product: Column, one: Column, other: Column) -> Column:
    """From <a,b>, <a,a> and <b,b>."""
    return F.when(one + other == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product * 2 / (one + other))))


def text_of(vector: Column, count: Column) -> Column:
    """A fingerprint as text: piece count and packed words, in hexadecimal."""
    return F.lower(F.concat_ws(".", F.hex(count), F.array_join(F.transform(vector, F.hex), ".")))


def _blocks(docs: DataFrame) -> tuple[Column, list, list[int], int]:
    """Block of a row by the range of its key, and of each block its highest key and the block before it.

    Only keys are read. Blocks hold about as many rows each, and there are at
    most MOST_BLOCKS of them, so what comes to the driver is bounded.
    """
    keys = docs.select("key")
    kind = docs.schema["key"].dataType.simpleString()
    rows = keys.count()
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    parts = max(1, min(MOST_BLOCKS, max(rows // ROWS_OF_BLOCK, min(spread, rows // 64))))
    if kind == "bigint":
        found = keys.agg(F.percentile_approx("key", [(k + 1) / parts for k in range(parts)], F.lit(max(10_000, 4 * parts))).alias("cuts")).first().cuts or []
    else:
        # text has no quantiles: those of a bounded sample of distinct keys
        drawn = keys.distinct().where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(DRAWN)) < int(min(1.0, SAMPLED_KEYS / max(1, rows)) * DRAWN))
        some = [r.key for r in drawn.orderBy("key").collect()]
        found = [some[(k + 1) * len(some) // parts - 1] for k in range(parts) if some]
    cuts = sorted(set(found))[:-1]  # the last block is open
    groups = [cuts[k : k + FANOUT] for k in range(0, len(cuts), FANOUT)] or [[]]
    typed = lambda values: F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>")
    below = lambda values: F.size(F.filter(values, lambda x: x < F.col("key")))
    if len(groups) == 1:
        block = below(typed(groups[0]))
    else:
        coarse = F.least(below(typed([g[-1] for g in groups])), F.lit(len(groups) - 1))
        block = coarse * FANOUT + below(F.element_at(F.array(*[typed(g) for g in groups]), coarse + 1))
    highest: list = [None] * (len(cuts) + 1)
    for b, key in keys.select(block.alias("block"), "key").groupBy("block").agg(F.max("key")).collect():
        highest[b] = key
    filled = [b for b, key in enumerate(highest) if key is not None]
    before = [0] * len(highest)
    for k, b in enumerate(filled):
        before[b] = filled[(k + 1) % len(filled)]  # the next higher block; the highest one's is the lowest
    return block, highest, before, len(filled)


def in_order_with_next(docs: DataFrame) -> DataFrame:
    """block, place, ghost, doc_id, text and next_text of documents by descending id.

    Rows are dealt by ranges of ids. A block's first document also goes, as a
    ghost, to the block before, so every document finds the next one beside it
    and no task needs more than its range.
    """
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select("doc_id", key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block, highest, before, filled = _blocks(docs)
    if not filled:
        return docs.select(F.lit(0).alias("block"), F.lit(0).alias("place"), F.lit(False).alias("ghost"), "doc_id", "text", F.col("text").alias("next_text"))
    heads = F.array(*[F.lit(h).cast("bigint" if whole else "string") for h in highest])
    to = F.array(*[F.lit(b) for b in before])
    out = docs.withColumn("block", block)
    first = F.col("key") == F.element_at(heads, F.col("block") + 1)
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.element_at(to, F.col("block") + 1).alias("block"), F.lit(True).alias("ghost"))
    out = out.withColumn("at", F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))))
    out = out.select("at.block", "at.ghost", "doc_id", "key", "text")
    order = Window.partitionBy("block").orderBy("ghost", F.desc("key"), F.desc_nulls_last("doc_id"), F.desc("text"))
    return out.select("block", "ghost", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many, or all, of the next document.
    """
    rows = in_order_with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("ghost"), "").otherwise(F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    rows = rows.select("block", "place", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    rows = rows.withColumn("own", pieces(F.col("text"))).withColumn("other", pieces(F.col("edited")))
    # an empty piece before each side's own keeps documents without pieces
    rows = rows.select("block", "place", "ghost", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n_own"), F.posexplode(F.concat(F.array(F.lit("")), "own", "other")).alias("at", "piece"))
    real = F.col("piece") != ""
    own, other = real & (F.col("at") <= F.col("n_own")), real & (F.col("at") > F.col("n_own"))
    a, b = packed_bits(F.col("piece"), own), packed_bits(F.col("piece"), other)
    keys = ["block", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    # rows lie by block already, so neither grouping shuffles
    runs = rows.groupBy(*keys, F.floor(F.col("at") / RUN).alias("run")).agg(
        F.count(F.when(own, 1)).alias("n_a"),
        F.count(F.when(other, 1)).alias("n_b"),
        *[F.sum(x).alias(f"a{k}") for k, x in enumerate(a)],
        *[F.sum(x).alias(f"b{k}") for k, x in enumerate(b)],
    )
    vectors = [F.array(*[F.col(f"{side}{k}") for k in range(len(a))]).alias(side) for side in "ab"]
    summed = runs.select(*keys, "n_a", "n_b", *vectors).groupBy(*keys).agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.collect_list("a").alias("a"), F.collect_list("b").alias("b")
    )
    packed = summed.select(*keys, "n_a", "n_b", *[total(F.col(side)).alias(side) for side in "ab"], *[lane_sums(F.col(side)).alias(f"l{side}") for side in "ab"])
    order = Window.partitionBy("block").orderBy("place")
    packed = packed.withColumn("lc", F.lead("la").over(order)).withColumn("n_c", F.lead("n_a").over(order)).where(~F.col("ghost"))
    packed = packed.withColumn("va", _centred(F.col("la"), F.col("n_a"))).withColumn("vb", _centred(F.col("lb"), F.col("n_b"))).withColumn("vc", _centred(F.col("lc"), F.col("n_c")))
    for x, y in ("aa", "bb", "cc", "ab", "ac"):
        packed = packed.withColumn(f"p{x}{y}", _dot(F.col(f"v{x}"), F.col(f"v{y}")))
    return packed.select(
        "doc_id", "n_chars", "edited_sha256",
        text_of(F.col("a"), F.col("n_a")).alias("fingerprint"),
        text_of(F.col("b"), F.col("n_b")).alias("edited_fingerprint"),
        likeness(F.col("pab"), F.col("paa"), F.col("pbb")).alias("near_edited"),
        likeness(F.col("pac"), F.col("paa"), F.col("pcc")).alias("near_next"),
    )
