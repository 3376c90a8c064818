"""Dense grids, trailing windows, as-of look-ups and running measures per item."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import periods_of_lead
from ..shared import written

ITEM = "canonical_item_number"
#: Different values of a column up to which their ranks are broadcast.
BROADCAST_RANKS = 250_000


def dense(series: DataFrame, items: DataFrame, period: str, step: str = "7 days") -> DataFrame:
    """item, t, period and s for every item and every period between the series' first and last; gaps are 0.

    ``series`` has one row an item and period; rows without a period are left
    out. An item's values are gathered in one map, at most one entry a period,
    before its calendar is exploded beside it: only items and their own values
    are shuffled, never the grid. The number of partitions is stated, as adaptive
    plans would size them by the items alone, before each becomes a calendar.
    """
    calendar = series.agg(F.min(period).alias("first"), F.max(period).alias("last")).select(F.expr(f"sequence(first, last, interval {step})").alias("calendar"))
    entry = F.struct(period, F.coalesce("consumption", F.lit(0.0)).cast("double"))
    known = series.where(F.col(period).isNotNull()).groupBy(ITEM).agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the shuffle comes before ``distinct``: a stated one after it would be taken for the same and dropped
    rows = items.select(ITEM).repartition(parts, ITEM).distinct().join(known, ITEM, "left").crossJoin(F.broadcast(calendar))  # one row
    rows = rows.select(ITEM, "known", F.posexplode("calendar").alias("t", period))
    return rows.select(ITEM, "t", period, F.coalesce(F.try_element_at("known", F.col(period)), F.lit(0.0)).alias("s"))


def _before(k: int | None = None):
    w = Window.partitionBy(ITEM).orderBy("t")
    return w.rowsBetween(Window.unboundedPreceding if k is None else -k, -1)


def trailing_sum(k: int) -> Column:
    """Sum over the k periods before the origin."""
    return F.coalesce(F.sum("s").over(_before(k)), F.lit(0.0))


def trailing_nonzero(k: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).over(_before(k)), F.lit(0))


def since_nonzero() -> Column:
    """Periods since the last demand before the origin; t + 1 where there was none."""
    return F.col("t") - F.coalesce(F.last(F.when(F.col("s") > 0, F.col("t")), ignorenulls=True).over(_before()), F.lit(-1))


def trailing_variation(k: int) -> Column:
    """Population standard deviation over mean of the k periods before the origin; 0 without demand."""
    mean = F.avg("s").over(_before(k))
    return F.when(mean > 0, F.stddev_pop("s").over(_before(k)) / mean).otherwise(0.0)


def weekly_frame(grid: DataFrame, attributes: DataFrame, period: str = "week", start: int = 52) -> DataFrame:
    """One row per item and origin: features of the weeks before it, the target from it on.

    The horizon is the item's own lead time in weeks. Sums over it, now and a
    year before, are differences of the item's running totals, which a window
    over all its rows holds beside each row while the row is formed; no row
    carries them on. A target whose horizon isn't closed is null.
    """
    rows = grid.join(_horizon(attributes), ITEM)
    windows = {
        **{f"s{k}": trailing_sum(k) for k in (4, 13, 26, 52)}, **{f"nz{k}": trailing_nonzero(k) for k in (13, 52)},
        "since_nz": since_nonzero(), "cv13": trailing_variation(13),
    }
    rows = rows.select(ITEM, "t", period, "h", _through().alias("through"), *[c.alias(n) for n, c in windows.items()])
    rows = rows.withColumn("totals", _totals()).where(F.col("t") >= start)
    before = _before_week
    t, h = F.col("t"), F.col("h")
    derived = {
        "trend": F.col("s4") / 4 - F.col("s13") / 13, "ly": before(F.least(t - start + h, t)) - before(t - start), "mean_all": before(t) / t,
        "woy": F.weekofyear(period), "month": F.month(period),
    }
    return rows.select(ITEM, "t", period, "h", (before(t + h) - before(t)).alias("target"), *windows, *[c.alias(n) for n, c in derived.items()])


def _horizon(attributes: DataFrame) -> DataFrame:
    return attributes.select(ITEM, periods_of_lead(F.col("corrected_lead_days"), 7).alias("h"))


def _through() -> Column:
    """Running total through the period."""
    return F.sum("s").over(Window.partitionBy(ITEM).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _totals() -> Column:
    """All running totals of the item, in order of its periods; they are as many as the calendar has."""
    return F.collect_list("through").over(Window.partitionBy(ITEM).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def _before_week(t: Column) -> Column:
    """Sum before period t by place in ``totals``; null beyond the last."""
    return F.when(t < 1, 0.0).otherwise(F.try_element_at("totals", F.greatest(t, F.lit(1)).cast("int")))


def forward_sums(grid: DataFrame, attributes: DataFrame, start: int = 52) -> DataFrame:
    """item, t, h, target and ly as in ``weekly_frame``, without the other features."""
    rows = grid.select(ITEM, "t", _through().alias("through")).withColumn("totals", _totals()).where(F.col("t") >= start).join(_horizon(attributes), ITEM)
    before = _before_week
    t, h = F.col("t"), F.col("h")
    return rows.select(ITEM, "t", "h", (before(t + h) - before(t)).alias("target"), (before(F.least(t - start + h, t)) - before(t - start)).alias("ly"))


def lagged_features(grid: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 6, 12), windows: tuple[int, ...] = (3, 6, 12), keep: tuple[Column, ...] = ()) -> DataFrame:
    """Monthly history features: lags, rolling means, deviations and demand counts, and those of all the past; columns of ``keep`` beside them."""
    w = Window.partitionBy(ITEM).orderBy("t")
    mean_all = F.avg("s").over(_before())
    return grid.select(
        ITEM, "t", "month", *keep,
        *[F.coalesce(F.lag("s", k).over(w), F.lit(0.0)).alias(f"lag{k}") for k in lags],
        *[F.coalesce(F.avg("s").over(_before(k)), F.lit(0.0)).alias(f"mean{k}") for k in windows],
        *[F.coalesce(F.stddev_pop("s").over(_before(k)), F.lit(0.0)).alias(f"std{k}") for k in windows],
        *[trailing_nonzero(k).alias(f"nz{k}") for k in windows],
        since_nonzero().alias("since_nz"), F.coalesce(mean_all, F.lit(0.0)).alias("mean_all"),
        F.when(mean_all > 0, F.stddev_pop("s").over(_before()) / mean_all).otherwise(0.0).alias("cv_all"),
    )


def monthly_frame(grid: DataFrame, attributes: DataFrame, start: int = 12, validation: int = 6, test: int = 12) -> DataFrame:
    """One row per item and origin whose horizon has closed: features of the months before it, the target from it on, and its part.

    The last ``test`` origins of an item are its test rows. Validation rows
    are those of the ``validation`` origins before that close by the first
    test origin, train rows close by the first validation origin, and what
    remains is a gap: no target reaches into the next part. An item with less
    than ``start`` months and its horizon has no rows.
    """
    through = F.sum("s").over(Window.partitionBy(ITEM).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lagged_features(grid, keep=(through.alias("through"),))
    names = [c for c in rows.columns if c not in (ITEM, "t", "month", "through", "since_nz")]
    horizon = attributes.select(ITEM, periods_of_lead(F.col("corrected_lead_days"), 30).alias("h"))
    series = rows.groupBy(ITEM).agg(F.array_sort(F.collect_list(F.struct("t", "month", "through", "since_nz", *names))).alias("series")).join(horizon, ITEM)
    h, n = F.col("h"), F.size("series")
    first_test = n - h - (test - 1)
    first_validation = first_test - validation

    def row(x: Column) -> Column:
        t = x["t"]
        part = F.when(t >= first_test, "test").when((t >= first_validation) & (t + h <= first_test), "validation").when(t + h <= first_validation, "train").otherwise("gap")
        target = F.try_element_at("series", (t + h).cast("int"))["through"] - F.try_element_at("series", t.cast("int"))["through"]
        month = F.month(x["month"])
        return F.struct(
            t.alias("t"), x["month"].alias("month"), target.alias("target"), part.alias("part"), *[x[c].alias(c) for c in names],
            (x["since_nz"] - 1).alias("since_nz"), (x["mean3"] - x["mean6"]).alias("trend"), (x["lag1"] / (x["mean6"] + 1)).alias("spike"),
            F.ceil(month / 3).cast("int").alias("quarter"), (month % 3 == 1).alias("opens_quarter"),
        )

    known = F.slice("series", start + 1, F.greatest(n - h - start + 1, F.lit(0)))
    return series.select(ITEM, "h", F.inline(F.transform(known, row)))


def as_of(lookups: DataFrame, events: DataFrame, key: str, at: str, value: str, when: str | None = None) -> DataFrame:
    """Each look-up with the latest event of its key on or before its date, null without one.

    Both sides go into one ordered stream per key, so the cost is a sort and
    no row is formed for pairs. Events of one date are taken together by the
    greatest ``value``; the look-up's other columns stay.
    """
    when = when or at
    name = f"{value}_{when}" if when == at else when
    left = lookups.select(key, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*lookups.columns).alias("__row"), F.lit(None).cast(events.schema[value].dataType).alias("__value"))
    right = events.groupBy(key, when).agg(F.max(value).alias("__value")).select(key, F.col(when).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), "__value")
    order = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.when(F.col("__side") == 0, F.struct(F.col("__value").alias("value"), F.col("__at").alias("day")))
    out = left.unionByName(right).withColumn("__found", F.last(event, ignorenulls=True).over(order)).where("__side = 1")
    return out.select("__row.*", F.col("__found.value").alias(value), F.col("__found.day").alias(name))


def running_balance(ledger: DataFrame, change: Column, key: str = ITEM) -> DataFrame:
    """Balance of each item after each day with a posting."""
    daily = ledger.groupBy(key, "txn_date").agg(F.sum(change).alias("change"))
    order = Window.partitionBy(key).orderBy("txn_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(key, "txn_date", F.sum("change").over(order).alias("balance"))


def window_count(lookups: DataFrame, events: DataFrame, key: str, at: str, when: str, days: int, since: Column | None = None) -> DataFrame:
    """Look-ups with n_events: their key's events from ``days`` before their date, or ``since`` if that is later, to the date, both days included.

    A count is the difference of two running counts, each looked up as of a
    day, so no look-up is paired with events.
    """
    order = Window.partitionBy(key).orderBy(when).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = events.groupBy(key, when).agg(F.count("*").alias("n")).select(key, F.col(when).alias("__when"), F.sum("n").over(order).alias("__through"))
    begin = F.date_sub(F.col(at), days)
    begin = begin if since is None else F.greatest(begin, since)
    rows = lookups.withColumn("__before", F.date_sub(begin, 1))
    rows = as_of(rows, running, key, at, "__through", "__when").withColumnRenamed("__through", "__upto").drop("__when")
    rows = as_of(rows, running, key, "__before", "__through", "__when")
    n = F.coalesce("__upto", F.lit(0)) - F.coalesce("__through", F.lit(0))
    return rows.withColumn("n_events", F.greatest(n, F.lit(0)).cast("bigint")).drop("__before", "__upto", "__through", "__when")


def abc_classes(values: DataFrame, a: float, b: float, item: str = ITEM, value: str = "value") -> DataFrame:
    """A, B or C by cumulative share of value, dearest first; ties by item.

    Running sums over all items are taken per value band first, so only as
    many rows as there are bands meet in one task. Items without value come
    last, and all have the whole share, so they need no order.
    """
    banded = values.withColumn("band", F.when(F.col(value) != 0, F.floor(F.log2(F.greatest(F.col(value), F.lit(1e-9))) * 32).cast("int")))
    bands = banded.where("band is not null").groupBy("band").agg(F.sum(value).alias("in_band"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("band", F.coalesce(F.sum("in_band").over(above), F.lit(0.0)).alias("above"), F.sum("in_band").over(Window.partitionBy()).alias("whole"))
    inside = Window.partitionBy("band").orderBy(F.desc(value), item).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # bands are at most some hundreds
    out = banded.where("band is not null").join(F.broadcast(bands), "band").select(item, value, ((F.col("above") + F.sum(value).over(inside)) / F.col("whole")).alias("share"))
    out = out.unionByName(banded.where("band is null").select(item, value, F.lit(1.0).alias("share")))
    return out.select(item, value, "share", F.when(F.col("share") <= a, "A").when(F.col("share") <= b, "B").otherwise("C").alias("abc"))


def _band(value: Column) -> Column:
    """Coarse steps that grow with the value: 16 to a factor of e, on both sides of 0."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 16).cast("int")


def placed(rows: DataFrame, order: list, groups: list[str] | None = None) -> DataFrame:
    """Rows with ``place``, from 1, in an order that tells all rows apart, within each of some groups.

    Ranges of groups and order are dealt out and written; their counts are
    added up, and rows are numbered within a range. A range is cut anywhere, so
    neither a group nor a run of equal values meets in one task.
    """
    groups = groups or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = written(rows.repartitionByRange(parts, *groups, *order).withColumn("__range", F.spark_partition_id()), "placed")
    counts = ranged.groupBy("__range", *groups).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range, and for each group that begins in it
    counts = counts.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = [F.col("__range") == F.col("__r"), *[F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)]]
    inside = F.row_number().over(Window.partitionBy("__range", *groups).orderBy(*order))
    return ranged.withColumn("__inside", inside).join(F.broadcast(counts), same).withColumn("place", F.col("__before") + F.col("__inside")).select(*rows.columns, "place")


def deciles(values: DataFrame, value: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-count bins by rank, ties by key: bin of rank r among n is ceil((r - 1) bins / (n - 1)) - 1, at least 0."""
    rows = placed(values.select(key, value), [value, key])
    rows = rows.crossJoin(F.broadcast(values.agg(F.count("*").alias("__n"))))  # one row
    rank = F.col("place") - 1
    return rows.select(key, value, F.greatest(F.lit(0), F.ceil(F.try_divide(rank * bins, F.col("__n") - 1)) - 1).cast("int").alias("bin"))


def _distinct_ranks(values: DataFrame, value: str, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """value, n and above: of each different value (of each of ``by``) its rows, and how many rows come before it. Values are counted first, so equal ones are one row."""
    by = by or []
    counts = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    counts = counts.withColumn("__band", (-_band(F.col(value)) if descending else _band(F.col(value))))
    bands = counts.groupBy(*by, "__band").agg(F.sum("n").alias("__size"))
    bands = bands.withColumn("__above", F.coalesce(F.sum("__size").over(Window.partitionBy(*by).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    order = F.desc(value) if descending else F.asc(value)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "__band").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__inside", inside).join(F.broadcast(bands), [*by, "__band"]).select(*by, value, "n", (F.col("__above") + F.col("__inside")).alias("above"))


def concentration(values: DataFrame, value: str, key: str, top: float = 0.2, rounded_up: bool = True) -> DataFrame:
    """Share of the total that the dearest ``top`` share of items holds."""
    ranks = _distinct_ranks(values, value, descending=True)
    k = F.ceil(F.col("__n") * top) if rounded_up else F.floor(F.col("__n") * top)
    rows = ranks.crossJoin(F.broadcast(values.agg(F.count("*").alias("__n"))))  # one row
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("above")))
    return rows.agg(F.try_divide(F.sum(F.col(value) * taken), F.sum(F.col(value) * F.col("n"))).alias("top_share"))


def positional(values: DataFrame, value: str, key: str, share: float, by: str) -> DataFrame:
    """Of each ``by`` the row at place int(n * share), from 0, in ascending order of value and key.

    Different values are counted until one holds the place; only rows of that
    value are then put in order.
    """
    sizes = values.groupBy(by).agg(F.count("*").alias("__n"))
    wanted = _distinct_ranks(values, value, [by]).join(F.broadcast(sizes), by).withColumn("__k", F.floor(F.col("__n") * share))
    # one value of each group
    wanted = wanted.where((F.col("above") <= F.col("__k")) & (F.col("__k") < F.col("above") + F.col("n"))).select(by, value, (F.col("__k") - F.col("above") + 1).alias("__place"))
    rows = placed(values.select(by, key, value).join(F.broadcast(wanted), [by, value]), [key], [by])
    return rows.where(F.col("place") == F.col("__place")).select(by, key, value)


def spearman(values: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns; rows with a null in either are left out."""
    return rank_matrix(values.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b]).select("spearman")


def rank_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and their rank correlation, ties by average rank, of every pair of columns (a before b in ``columns``); nulls rank nowhere, and drop out of their pairs.

    All columns' values are counted and ranked at once; rows look the ranks of
    their values up column by column, in memory where a column has few different
    ones, and one Gram matrix of the ranks has all pairs.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("column"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)])
    melted = rows.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null")
    ranks, _ = written(_distinct_ranks(melted, "value", ["column"]).select("column", "value", "n", (F.col("above") + (F.col("n") + 1) / 2).alias("rank")), "ranks")
    sizes = {r["column"]: r for r in ranks.groupBy("column").agg(F.count("*").alias("values"), F.sum("n").alias("rows")).collect()}  # one row a column
    out = rows.select(*[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])
    for k in range(len(columns)):
        own = ranks.where(F.col("column") == k).select(F.col("value").alias(f"v{k}"), F.col("rank").alias(f"r{k}"))
        out = out.join(F.broadcast(own) if k not in sizes or sizes[k]["values"] <= BROADCAST_RANKS else own, f"v{k}", "left").drop(f"v{k}")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    total = rows.count()
    whole = [k for k in sizes if sizes[k]["rows"] == total]
    found: dict[tuple[int, int], float | None] = {}
    if len(whole) > 1:
        # columns without nulls take one product of ranks with themselves
        vectors = VectorAssembler(inputCols=[f"r{k}" for k in whole], outputCol="ranks").transform(out).select("ranks")
        matrix = Correlation.corr(vectors, "ranks").first()[0].toArray()
        found = {(i, j): float(matrix[whole.index(i), whole.index(j)]) for i, j in pairs if i in whole and j in whole}
    rest = [p for p in pairs if p not in found]
    if rest:
        row = out.agg(*[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in rest]).first()
        found |= {(i, j): row[f"c{i}_{j}"] for i, j in rest}
    # one row a pair of columns
    return rows.sparkSession.createDataFrame([(columns[i], columns[j], found[i, j]) for i, j in pairs], "a string, b string, spearman double")


def visible_demand(jobs: DataFrame, key: str, qty: str, ahead: int = 30) -> DataFrame:
    """Demand due within ``ahead`` days after each month's first day that was released by then.

    A job counts at the few month starts that lie between its bounds, so it is
    exploded to them and nothing is joined by range.
    """
    earliest = F.greatest(F.col("release_date"), F.date_sub("due_date", ahead))
    first = F.when(F.trunc(earliest, "month") == earliest, earliest).otherwise(F.add_months(F.trunc(earliest, "month"), 1))
    last = F.date_sub("due_date", 1)
    rows = jobs.withColumn("first", first).where(F.col("first") <= last)
    rows = rows.withColumn("origin", F.explode(F.sequence(F.col("first"), last, F.expr("interval 1 month"))))
    return rows.groupBy(key, "origin").agg(F.sum(qty).cast("bigint").alias("visible"))


def visible_within_lead(demand: DataFrame, origins: DataFrame, lead: DataFrame, key: str = ITEM) -> DataFrame:
    """key, origin and visible: demand due after an origin and within the key's own lead time, released by the origin.

    ``demand`` has key, release, due and qty; ``origins`` days; ``lead`` key and
    lead in days. A line is visible from its release, or from its lead time
    before it is due if that is later, until the day before it is due. So what
    is visible on a day is what has begun less what has ended, one running sum
    over the key's begins, ends and origins in order; nothing is joined by
    range. Days of a key are summed first, so a key's stream is bounded by the
    calendar. A line without a release is visible throughout; one without a due
    day never is. Origins on which nothing is visible are left out.
    """
    lines = demand.where(F.col("due").isNotNull()).join(lead, key)
    begin = F.greatest(F.coalesce("release", F.date_sub("due", F.col("lead"))), F.date_sub("due", F.col("lead")))
    lines = lines.withColumn("begin", begin).where(F.col("begin") < F.col("due"))
    steps = lines.select(key, F.explode(F.array(F.struct(F.col("begin").alias("day"), F.col("qty").alias("change")), F.struct(F.col("due").alias("day"), (-F.col("qty")).alias("change")))).alias("step"))
    steps = steps.groupBy(key, F.col("step.day").alias("day")).agg(F.sum("step.change").alias("change"))
    asked = steps.select(key).distinct().crossJoin(F.broadcast(origins.select(F.col("origin").alias("day"))))  # a calendar's days
    stream = steps.withColumn("is_origin", F.lit(False)).unionByName(asked.withColumn("change", F.lit(0.0)).withColumn("is_origin", F.lit(True)))
    running = F.sum("change").over(Window.partitionBy(key).orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # sums of floating numbers that have come and gone leave dust
    return stream.withColumn("visible", F.round(running, 9)).where("is_origin and visible > 0").select(key, F.col("day").alias("origin"), "visible")


def trailing_mean(k: int, least: int) -> Column:
    """Mean of the k periods before the origin, null until ``least`` have passed."""
    return F.when(F.col("t") >= least, F.avg("s").over(_before(k)))


def growth(grid: DataFrame, periods_a_year: int = 12) -> DataFrame:
    """Linear trend of each item as a share of its mean a year; null without demand."""
    out = grid.groupBy(ITEM).agg(F.regr_slope("s", F.col("t").cast("double")).alias("slope"), F.avg("s").alias("mean"))
    return out.select(ITEM, F.try_divide(F.col("slope") * periods_a_year, "mean").alias("growth"))
