"""Retrieval metrics, answer-quality ratios, latency percentiles and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.session import materialize

TARGETS = {"recall_at_5": 0.80, "faithfulness": 0.85, "valency": 0.90}


def ir_metrics(lists: DataFrame, k: int = 5) -> DataFrame:
    """lists (query_id, retrieved array, expected array) -> recall@k, precision@k, rr and ndcg@k of each query."""
    top, expected = F.slice("retrieved", 1, k), F.array_distinct("expected")
    n_expected = F.size(expected)
    hits = F.size(F.filter(top, lambda x: F.array_contains("expected", x)))
    ranks = F.filter(
        F.transform("retrieved", lambda x, i: F.when(F.array_contains("expected", x), i + 1)), lambda x: x.isNotNull()
    )
    gains = F.transform(top, lambda x, i: F.when(F.array_contains("expected", x), 1 / F.log2(i + 2)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), n_expected), F.lit(1))), lambda i: 1 / F.log2(i + 1))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return lists.select(
        "query_id",
        F.when(n_expected == 0, 1.0).otherwise(F.size(F.array_intersect(top, expected)) / n_expected).alias("recall"),
        F.when(F.size(top) == 0, 0.0).otherwise(hits / F.size(top)).alias("precision"),
        F.when(F.size(ranks) == 0, 0.0).otherwise(1 / F.get(ranks, F.lit(0))).alias("rr"),
        F.when(n_expected == 0, 1.0).otherwise(total(gains) / total(ideal)).alias("ndcg"),
    )


def suite_means(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("recall", "precision", "rr", "ndcg")), F.count("*").alias("n_queries"))


#: Intervals that a round divides the range of a rank into, and the rows at which an interval is sorted.
PARTS, SORTED_ROWS = 4096, 4096


def order_statistics(df: DataFrame, value: str, ranks: Column, by: list[str]) -> DataFrame:
    """(by, rank, v): the values at the given ranks (an array of numbers from 0, may use the group's size ``n``) of each group.

    Each round counts the values in equal parts of the interval that holds a rank, with sums on the map side, and goes on
    with the part that holds it; an interval of one value, or of few rows, ends it. So no task ever has a group's values.
    Null, NaN and infinite values are left out. Groups may be null.
    """
    number, names = F.col(value).cast("double"), by
    by = [f"_g{i}" for i in range(len(names))]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))).select(*(F.col(c).alias(g) for c, g in zip(names, by)), F.col(value).alias("v"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = sizes.select(*by, F.explode(F.array_distinct(ranks)).alias("rank"), F.lit(0).cast("long").alias("below"), "n", "low", "high")
    state = materialize(state.where("rank >= 0 and rank < n"), "ranks")
    done = state.where("low = high").select(*by, "rank", F.col("low").alias("v"))
    while True:
        state = state.where("low < high")
        wide = state.where(F.col("n") > SORTED_ROWS)
        if wide.isEmpty():
            break
        # Halves, so that no difference overflows; every step is monotone, so parts are intervals, and the first and the
        # last value are in different ones. Values that differ by less than a double tells are parts of their own.
        half = lambda c: F.col(c).cast("double") / 2
        span = half("high") - half("low")
        part = F.when(span > 0, F.least(F.lit(PARTS - 1), F.floor(F.try_divide(half("v") - half("low"), span) * PARTS)))
        parts = _within(rows, wide, by).groupBy(*by, "rank", "below", part.alias("part"), F.when(span > 0, None).otherwise(F.col("v")).alias("own"))
        counts = parts.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        # A row for each part of a rank's interval, so PARTS at most.
        before = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("part", "own")) - F.col("n")
        counts = counts.withColumn("below", F.col("below") + before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        few = state.where(F.col("n") <= SORTED_ROWS)
        state = materialize(counts.select(*few.columns).unionByName(few), "ranks")
        done = done.unionByName(state.where("low = high").select(*by, "rank", F.col("low").alias("v")))
    few = _within(rows, state, by).groupBy(*by, "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("v"))
    found = done.unionByName(few.select(*by, "rank", F.get("v", (F.col("rank") - F.col("below")).cast("int")).alias("v")))
    return found.select(*(F.col(g).alias(c) for c, g in zip(names, by)), "rank", "v")


def _within(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """rows once for each rank whose interval holds them, with the rank's columns."""
    s = state.withColumnsRenamed({c: f"_{c}" for c in by})
    inside = F.col("v").between(F.col("low"), F.col("high"))
    for c in by:
        inside &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(s, inside).drop(*(f"_{c}" for c in by))


def _at_points(df: DataFrame, value: str, points: tuple[float, ...], by: str | None, pick) -> DataFrame:
    """One row for each group: pick(p, n, value at a rank) of each point."""
    keys = [by] if by else []
    ends = [rank(F.lit(p) * (F.col("n") - 1)).cast("long") for p in points for rank in (F.floor, F.ceil)]
    rows = df.select(*(F.col(c).alias("_by") for c in keys), F.col(value).alias("_value"))
    keys = ["_by"] if by else []
    found = order_statistics(rows, "_value", F.array(*ends), keys).select(*(F.col(c).alias("_own") for c in keys), "rank", "v")
    held = found.groupBy(*(["_own"] if by else [])).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    number = F.col("_value").cast("double")
    sizes = rows.where(F.col("_value").isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))).groupBy(*keys).agg(F.count("*").alias("n"))
    if not by:
        return sizes.crossJoin(held).select(*(pick(p).alias(f"p{int(p * 100)}") for p in points))  # one row each
    both = sizes.join(held, F.col("_by").eqNullSafe(F.col("_own")))
    return both.select(F.col("_by").alias(by), *(pick(p).alias(f"p{int(p * 100)}") for p in points))


def floor_percentiles(df: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99), by: str | None = None) -> DataFrame:
    """sorted[int(p * (n - 1))], without interpolation, by ``order_statistics``."""
    return _at_points(df, value, points, by, lambda p: F.col("at")[F.floor(F.lit(p) * (F.col("n") - 1))])


def percentiles(df: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99), by: str | None = None) -> DataFrame:
    """Interpolated percentiles, by ``order_statistics``."""

    def pick(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.col("at")[F.floor(place)].cast("double"), F.col("at")[F.ceil(place)].cast("double")
        return low + (high - low) * (place - F.floor(place))

    return _at_points(df, value, points, by, pick)


def answer_ratios(items: DataFrame, supported: float = 0.4) -> DataFrame:
    """items (id, question, contexts array, answer, expected) -> context precision and recall, faithfulness, relevance, overall.

    Words of four or more letters count, and a text holds a word if it contains it as a substring.
    """
    long_words = lambda c: F.filter(T.tokens(c), lambda w: F.length(w) >= 4)
    sentences = lambda c: F.filter(F.transform(F.split(c, r"[.!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 10)
    # Columns of their own, so that the lambdas below name them and don't compute them for every word.
    rows = items.select(
        "id",
        F.transform("contexts", F.lower).alias("low"),
        F.lower(F.array_join("contexts", " ")).alias("joined"),
        long_words(F.col("question")).alias("q"),
        F.transform(sentences(F.coalesce("expected", F.lit(""))), long_words).alias("wanted"),
        F.transform(sentences(F.col("answer")), long_words).alias("claims"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.lower(F.coalesce("answer", F.lit(""))).alias("answer"),
    )
    joined, none = F.col("joined"), F.size("low") == 0
    share = lambda xs, test: F.size(F.filter(xs, test)) / F.size(xs)
    precision = F.when(none, 0.0).when(F.size("q") == 0, 1.0).otherwise(share("low", lambda c: F.exists("q", lambda w: F.contains(c, w))))
    recall = F.when(none | (F.size("wanted") == 0), 1.0).otherwise(share("wanted", lambda s: (F.size(s) == 0) | F.exists(s, lambda w: F.contains(joined, w))))

    def held(words: Column) -> Column:
        return (F.size(words) == 0) | (F.size(F.filter(words, lambda w: F.contains(joined, w))) / F.greatest(F.size(words), F.lit(1)) >= supported)

    faithful = F.when(F.col("answer") == "", 1.0).when(none, 0.0).when(F.size("claims") == 0, 1.0).otherwise(share("claims", held))
    relevance = F.when((F.col("question") == "") | (F.col("answer") == ""), 0.0).when(F.size("q") == 0, 1.0).otherwise(share("q", lambda w: F.contains(F.col("answer"), w)))
    out = rows.select("id", precision.alias("context_precision"), recall.alias("context_recall"), faithful.alias("faithfulness"), relevance.alias("answer_relevance"))
    mean = (F.col("context_precision") + F.col("context_recall") + F.col("faithfulness") + F.col("answer_relevance")) / 4
    return out.withColumn("overall", mean)


def pass_ratios(cases: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The share of all cases that pass each check; a null result doesn't pass."""
    return cases.agg(*(F.avg(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in checks.items()), F.count("*").alias("n_cases"))


def regression_gate(metrics: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row of metrics -> (metric, value, target, passed) for each target."""
    targets = targets or TARGETS
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("target")) for m, t in targets.items()))
    return metrics.select(F.explode(rows).alias("r")).select("r.*").withColumn("passed", F.coalesce(F.col("value") >= F.col("target"), F.lit(False)))
