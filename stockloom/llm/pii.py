"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

What the base patterns find are the seeds, and long hexadecimal strings and
keys of public formats are those of a fifth kind, secrets. The words around
every mention of an identifier-like string (a seed or any other token with a
digit or an @) are its lexical patterns, and patterns and instances make a
graph. In a few rounds Spark scores patterns by the share of their distinct
instances that are known or believed to be of a kind, then unseen instances by
the patterns they occur in; what is believed is a seed of the next round, so
patterns that hold no seed can enter. Mentions in patterns of high confidence
whose form could be of that kind are added to the spans. A string is reported
as a secret only in such a pattern, a seed, too.

Edge cases: a null text is an empty one; a text without spans has counts 0, an
empty ``spans`` and the hash of the empty string. A token of any length counts. Matches of different kinds
may overlap; matches of one kind do not, and added spans overlap none. Digits
and letters are ASCII. Repeated rows and ids are separate documents. An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
ROUNDS = 3
#: A pattern's least confidence and distinct seeds to spread belief, and to add spans.
SPREADS, SPREADS_SEEDS, SURE, SURE_SEEDS = 0.5, 3, 0.8, 5
#: How far a mention's context reaches, in characters; words that it doesn't hold whole are left out.
BEFORE, AFTER = 48, 24
#: Parts that the mentions of one pattern, or the patterns of one instance, are dealt to in joins: as many as shuffle partitions, and so many at least.
SALTS = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# possessive forms and the look-behind give the same leftmost matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s\"'`<>]*")
_QUOTES = frozenset("\"'`<>")
_KEY = re.compile(r"[0-9A-Fa-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]+\.[\w-]+\.[\w-]+")
_DIGITS = re.compile(r"[^0-9]")
_EDGE = "\"'()[]{}<>.,;:!?"


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append((start, free))
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and (not p or int(p) <= 255)
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in even)) % 10 == 0


def _chains(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), _DIGITS.sub("", m[0])) for m in _CARD.finditer(text)]


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    cards = [(s, e) for s, e, d in _chains(text) if 14 <= len(d) <= 19 and luhn(d)]
    spans = ((0, _emails(text)), (1, _ips(text)), (2, cards), (3, _phones(text)))
    return sorted((s, kind, e) for kind, found in spans for s, e in found)


def _is_key(mention: str) -> bool:
    return bool(_KEY.fullmatch(mention)) and any(c.isdigit() for c in mention) and any(c.isalpha() for c in mention)


def _fits(mention: str) -> int:
    """Kinds, as bits, that a string's form could be of."""
    digits = len(_DIGITS.sub("", mention))
    groups = [g for g in re.split(r"[^0-9]+", mention) if g]
    key = len(mention) >= 16 and digits >= 2 and any(c.isalpha() for c in mention) and "@" not in mention
    return (mention.count("@") == 1) | (len(groups) == 4 and max(map(len, groups)) <= 3 and mention.count(".") >= 3) << 1 | (12 <= digits <= 19) << 2 | (7 <= digits <= 15) << 3 | key << SECRET


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The word before, both words before, the word before and the one after, and the nearest label before (a word that ends with a colon or an equals sign)."""
    near, far = max(0, start - BEFORE), end + AFTER
    words = text[near:start].split()
    if near and words and not text[near - 1].isspace() and not text[near].isspace():
        del words[0]
    before = [x for x in (w.strip("\"'`<>") for w in words) if x]
    left = [w for w in (x.strip(_EDGE).lower() for x in before[-2:]) if w]
    after = text[end:far].split(None, 1)
    if len(after) == 1 and far < len(text) and not text[far - 1].isspace() and not text[far].isspace():
        after = []
    right = [w for w in (x.strip(_EDGE).lower() for x in after[:1]) if w]
    out = []
    if left:
        out.append(f"l|{left[-1]}")
        if right:
            out.append(f"lr|{left[-1]}|{right[0]}")
    if len(left) == 2:
        out.append(f"ll|{left[0]}|{left[1]}")
    for k in range(len(before) - 1, -1, -1):
        if before[k][-1] in ":=":
            label = before[k][:-1] or (before[k - 1] if k else "")
            if label:
                out.append(f"k|{label.strip(_EDGE).lower()}")
            break
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, list[str]]]:
    """(start, end, kind or -1, forms, instance, patterns) of seeds and other identifier-like strings."""
    spans = [(s, e, kind) for s, kind, e in base]
    starts, ends = [], []  # of what is taken, as disjoint stretches

    def take(found: list[tuple[int, int]]) -> None:
        rows = sorted([*zip(starts, ends, strict=True), *found])
        starts.clear()
        ends.clear()
        for s, e in rows:
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)

    def free(start: int, end: int) -> bool:
        k = bisect.bisect_left(starts, end) - 1
        return k < 0 or ends[k] <= start

    take([(s, e) for s, e, _ in spans])
    rest = [(s, e) for s, e, d in _chains(text) if len(d) >= 7 and free(s, e) and not (e < len(text) and text[e].isalnum()) and not (s and text[s - 1].isalnum())]
    take(rest)
    done = 0
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace() and text[start - 1] not in _QUOTES:
            start -= 1
        done = _TOKEN.match(text, m.start()).end()
        token = text[start:done]
        begin = start + len(token) - len(token.lstrip(_EDGE))
        stop = begin + len(token.strip(_EDGE))
        if stop > begin and free(begin, stop):
            rest.append((begin, stop))
    spans += [(s, e, SECRET if _is_key(text[s:e]) else -1) for s, e in rest]
    out = []
    for s, e, kind in sorted(spans):
        found = text[s:e]
        instance = int.from_bytes(hashlib.blake2b(found.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        fits = _fits(found)
        if (kind >= 0 or fits) and (patterns := _patterns(text, s, e)):
            out.append((s, e, kind, fits, instance, patterns))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("fits", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span_names, names = ("start", "kind", "end"), ("start", "end", "kind", "fits", "instance", "patterns")
    for batch in batches:
        spans, found = [], []
        for text in batch.column(2).to_pylist():
            base = base_spans(text) if text and _MARK.search(text) else []
            spans.append([dict(zip(span_names, s, strict=True)) for s in base])
            found.append([dict(zip(names, m, strict=True)) for m in mentions(text, base)] if text and _MARK.search(text) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_MENTION))], ["row", "doc_id", "base", "mentions"])


def _dealt(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """Join on ``key`` by parts of ``by``: a pattern may hold a large share of all mentions, an instance stand in very many patterns."""
    salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(parts, [key, "part"]).drop("part")


_SPANS = "array<struct<start int, kind int, end int>>"


def _could_be() -> Column:
    return F.expr("shiftright(fits, kind)").bitwiseAND(F.lit(1)) == 1


def confident_patterns(scanned: DataFrame) -> DataFrame:
    """pattern, kind and confidence of patterns that add spans, from the pattern-instance graph."""
    edges = scanned.select(F.explode("mentions").alias("m")).select("m.kind", "m.fits", "m.instance", F.explode("m.patterns").alias("pattern"))
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits")), "pii-edges")
    total = materialize(edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.count(F.when(F.col("kind") >= 0, 1)).alias("seeds")), "pii-totals")
    seeds = edges.where("kind >= 0").select("pattern", "kind", F.lit(1.0).alias("belief"))
    unseen = edges.where("kind < 0").select("pattern", "instance", "fits")
    known = seeds
    for turn in range(ROUNDS + 1):
        support = known.groupBy("pattern", "kind").agg(F.sum("belief").alias("held"), F.count("*").alias("support")).where(F.col("support") >= SPREADS_SEEDS)
        scored = support.join(total.select("pattern", "instances"), "pattern").withColumn("confidence", F.col("held") / (F.col("instances") + 1))
        scored = materialize(scored.select("pattern", "kind", "support", "confidence"), "pii-scores")
        if turn == ROUNDS:
            break
        spread = scored.where(F.col("confidence") >= SPREADS).select("pattern", "kind", "confidence")
        belief = _dealt(unseen, spread, "pattern", "instance").where(_could_be()).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("belief"))
        # what is believed counts for every pattern it stands in
        believed = _dealt(unseen.drop("fits"), belief.where(F.col("belief") >= SPREADS), "instance", "pattern").select("pattern", "kind", "belief")
        known = seeds.unionByName(believed)
    return scored.where((F.col("confidence") >= SURE) & (F.col("support") >= SURE_SEEDS)).select("pattern", "kind", "confidence")


def _listed(spans):
    names = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _is(kind: int):
    return lambda span: span["kind"] == kind


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(text).cast("string"))
    mention = "array<struct<start int, end int, kind int, fits int, instance long, patterns array<string>>>"
    return materialize(rows.mapInArrow(_scan, f"row long, doc_id {kind}, base {_SPANS}, mentions {mention}"), "pii-scan")


def _added(scanned: DataFrame) -> DataFrame:
    """row, start, end and kind of mentions that confident patterns are sure of."""
    sure = confident_patterns(scanned)
    # seeds of secrets stand for themselves where their pattern is sure of them
    unseen = scanned.select("row", F.explode("mentions").alias("m")).where((F.col("m.kind") < 0) | (F.col("m.kind") == SECRET))
    fits = F.when(F.col("m.kind") == SECRET, F.lit(1 << SECRET)).otherwise(F.col("m.fits"))
    unseen = unseen.select("row", "m.start", "m.end", fits.alias("fits"), F.explode("m.patterns").alias("pattern"))
    hits = _dealt(unseen, sure, "pattern", "row").where(_could_be())
    return hits.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added ones, secrets too), n_added of the four kinds, n_secret and secret_spans, and n_found, all of them, of every document."""
    scanned = _scanned(docs, text)
    added = _added(scanned).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    out = scanned.select("row", "doc_id", "base").join(added, "row", "left")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.coalesce("added", F.array().cast(_SPANS))
    extra, secrets = F.filter(every, lambda x: x["kind"] != SECRET), F.filter(every, _is(SECRET))
    return out.select(
        "doc_id", *counts,
        F.sha2(F.encode(_listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", every))).alias("spans"),
        F.size(extra).cast("long").alias("n_added"),
        F.size(secrets).cast("long").alias("n_secret"),
        _listed(F.array_sort(secrets)).alias("secret_spans"),
        (F.size("base") + F.size(every)).cast("long").alias("n_found"),
    )


def held_out(docs: DataFrame, share: int = 3, text: str = "text") -> DataFrame:
    """How well contexts alone find identifiers: kind, hidden, found and wrong.

    One in ``share`` seeds, by a hash of the instance, is hidden, so that the
    graph sees only its form and contexts. ``hidden`` counts their mentions with
    a context, ``found`` those that confident patterns give their own kind, and
    ``wrong`` those that they give another.
    """
    scanned = _scanned(docs, text)
    hide = lambda m: (m["kind"] >= 0) & (F.pmod(F.xxhash64(m["instance"], F.lit(3)), F.lit(share)) == 0)
    masked = scanned.withColumn("mentions", F.transform("mentions", lambda m: m.withField("kind", F.when(hide(m), -1).otherwise(m["kind"]))))
    truth = scanned.select("row", F.explode(F.filter("mentions", hide)).alias("m")).select("row", "m.start", "m.end", F.col("m.kind").alias("kind"))
    found = _added(masked).withColumnRenamed("kind", "told")
    both = truth.join(found, ["row", "start", "end"], "left")
    names = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
    return both.groupBy(F.element_at(names, F.col("kind") + 1).alias("kind")).agg(
        F.count("*").alias("hidden"), F.count(F.when(F.col("told") == F.col("kind"), 1)).alias("found"), F.count(F.when(F.col("told") != F.col("kind"), 1)).alias("wrong")
    )
