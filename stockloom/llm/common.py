"""Small pieces that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window


def id_text(name: str = "doc_id") -> Column:
    """A document id as text; a missing one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(k: int, name: str = "doc_id") -> Column:
    """crc32 of the id's text modulo ``k``: the fold that splits training rows from held-out ones."""
    return F.crc32(id_text(name)) % k


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The type that a column has in Arrow batches."""
    return to_arrow_type(df.schema[name].dataType)


#: Most keys that are broadcast as heavy, and fewest rows of such a key.
MOST_HEAVY, HEAVY = 10_000, 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, uses: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` to ``facts``, which have each key once and say how many of the ``total`` rows use it.

    Keys of more than total / MOST_HEAVY rows are broadcast, and there are fewer
    than MOST_HEAVY of them; their rows are then dealt by ``spread``. So no key
    brings its rows together in one task. Both sides should be written tables
    or cheap, as ``facts`` are read twice.
    """
    least = max(HEAVY, total // MOST_HEAVY)
    others = F.struct(*[c for c in facts.columns if c not in (key, uses)])
    heavy = F.broadcast(facts.where(F.col(uses) > least).select(key, others.alias("__heavy")))
    # 0, but not a constant: one that the optimizer knows would leave the key alone to deal rows by
    zero = F.when(F.col(uses) < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    light = facts.where(F.col(uses) <= least).select(key, others.alias("__light"), zero.alias("__salt"))
    out = rows.join(heavy, key, "left").withColumn("__salt", F.when(F.col("__heavy").isNotNull(), spread.bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long"))
    out = out.join(light, [key, "__salt"], "left").withColumn("__facts", F.coalesce("__heavy", "__light"))
    return out.select(*rows.columns, "__facts.*")


#: Rows of a sample over all values of a label, where values are many, each has fewer; and labels of which rows are taken.
MOST_ROWS, BROADCAST_LABELS = 100_000, 10_000


def sample_by(df: DataFrame, label: str, most: int, text: str = "text") -> DataFrame:
    """At most ``most`` different rows of each value of ``label``, drawn by a hash of doc_id and text; of each of very many values fewer, but one at least.

    One narrow pass counts the labels; the second keeps rows whose draw lies
    below most/count or is the label's least. Rows of one draw are equal in id
    and text, and one of them stands for all, so no id or text, however often
    repeated, adds more than a row. What is left is about ``most`` rows a
    label, and only then they are cut to ``most``. Of more than MOST_ROWS
    values those with most rows are taken.
    """
    draw = F.pmod(F.xxhash64(id_text(), *[F.col(text) for _ in (0,) if text in df.columns], F.lit(17)), F.lit(1 << 60)) / float(1 << 60)
    df = df.where(F.col(label).isNotNull()).withColumn("__draw", draw)
    counts = df.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"), F.min("__draw").alias("__least"))
    values = counts.count()
    if values > MOST_ROWS:
        counts, values = counts.orderBy(F.desc("__n"), "__label").limit(MOST_ROWS), MOST_ROWS
    most = max(1, min(most, MOST_ROWS // max(1, values)))
    counts = F.broadcast(counts) if values <= BROADCAST_LABELS else counts
    wanted = (F.col("__draw") < F.lit(float(most)) / F.col("__n")) | (F.col("__draw") == F.col("__least"))
    drawn = df.join(counts, F.col(label) == F.col("__label")).where(wanted).drop("__label", "__n", "__least").dropDuplicates([label, "__draw"])
    place = F.row_number().over(Window.partitionBy(label).orderBy("__draw"))
    return drawn.withColumn("__place", place).where(F.col("__place") <= most).drop("__draw", "__place")
