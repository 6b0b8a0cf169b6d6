"""Evaluation: latency and accuracy statistics, similarity matrices, threshold sweeps, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import cosine

#: Vectors whose pairs are all compared.
MOST_COMPARED = 5_000
#: First threshold, step and number of the sweep; the products are those of repeated addition to the first value.
SWEEP = (0.40, 0.02, 28)
# Round trips in ms that other services are compared with, estimates and not measurements.
ROUND_TRIPS = {"GPT-3.5 Turbo": 300.0, "GPT-4o": 800.0, "Claude 3 Sonnet": 600.0, "Local Llama 3": 2000.0}


def correct(expected: Column, matched: Column, intent: Column) -> Column:
    """Whether a result is right: '' stands for an input that should not match."""
    return F.when(expected == "", ~matched).otherwise(matched & F.coalesce(intent == expected, F.lit(False)))


#: Groups of at most so many rows are ranked whole; of larger ones only the values near a wanted rank.
WHOLE_GROUP = 10_000
#: Approximate percentiles are at most 1 / ACCURACY of the ranks off; brackets reach MARGIN to both sides.
ACCURACY, MARGIN = 10_000, 5e-4
#: Groups whose brackets are broadcast.
MOST_GROUPS = 20_000


def _beside(df: DataFrame, keys: list[str], other: DataFrame, keep: bool = False) -> DataFrame:
    """df joined with one row for each group, null keys included; with `keep`, groups that have none stay."""
    how = "left" if keep else "inner"
    renamed = other.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(renamed, same, how).drop(*[f"__k{i}" for i in range(len(keys))])


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """For each group the values at exact places among its sorted values, nulls left out.

    ranks: name -> (share, function from a group's number of values to the place, counted from 0 and near share of them). A
    first pass brackets each place by approximate percentiles, a second one counts the values below the bracket, and only
    values inside a bracket, about a thousandth of a large group, are sorted by group. So no group is sorted in one task.
    """
    rows = df.select(*keys, F.col(value).alias("__v")).filter("__v IS NOT NULL")
    names = list(ranks)
    shares = [min(1.0, max(0.0, ranks[x][0] + side * MARGIN)) for x in names for side in (-1, 1)]
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", shares, ACCURACY).alias("__p"))
    whole = F.col("__n") <= WHOLE_GROUP
    brackets = F.array(*[F.struct(F.when(whole, F.col("__min")).otherwise(F.col("__p")[2 * i]).alias("low"), F.when(whole, F.col("__max")).otherwise(F.col("__p")[2 * i + 1]).alias("high"), ranks[x][1](F.col("__n")).cast("long").alias("place")) for i, x in enumerate(names)])
    bounds = bounds.select(*keys, brackets.alias("__b"))
    few = not keys or df.select(*keys).distinct().limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    beside = _beside(rows, keys, F.broadcast(bounds) if few else bounds)
    below = beside.groupBy(*keys).agg(*[F.sum((F.col("__v") < F.col("__b")[i]["low"]).cast("long")).alias(f"__below{i}") for i in range(len(names))])
    near = F.filter(F.transform("__b", lambda b, i: F.when(F.col("__v").between(b["low"], b["high"]), F.struct(i.alias("i"), b["place"].alias("place")))), lambda x: x.isNotNull())
    inside = beside.select(*keys, "__v", F.explode(near).alias("x")).select(*keys, "__v", "x.i", "x.place")
    ranked = inside.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "i").orderBy("__v")) - 1)
    at = F.col("__r") + F.element_at(F.array(*[F.col(f"__below{i}") for i in range(len(names))]), F.col("i") + 1)
    found = _beside(ranked, keys, F.broadcast(below) if few else below).filter(at == F.col("place"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("__v"))).alias(x) for i, x in enumerate(names)])


def by_index(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the value at index floor(n * share) of the sorted values, at most the last, named as in shares."""
    at = lambda share: lambda n: F.least(F.floor(n * F.lit(share)), n - 1)
    return order_statistics(df, keys, value, {name: (s, at(s)) for name, s in shares.items()})


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the quantiles by linear interpolation between neighbours, as doubles."""
    at = lambda s, up: lambda n: (F.ceil if up else F.floor)((n - 1) * F.lit(s))
    ranks = {f"{name}__{side}": (s, at(s, side == "high")) for name, s in shares.items() for side in ("low", "high")}
    ends = _beside(order_statistics(df, keys, value, ranks), keys, df.groupBy(*keys).agg(F.count(value).alias("__n")))
    part = lambda s: (F.col("__n") - 1) * F.lit(s) - F.floor((F.col("__n") - 1) * F.lit(s))
    low, high = (lambda name, side=side: F.col(f"{name}__{side}").cast("double") for side in ("low", "high"))
    return ends.select(*keys, *[(low(name) + (high(name) - low(name)) * part(s)).alias(name) for name, s in shares.items()])


def latency_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, avg, min, max, standard deviation, p50 (upper median) and p95 by index of each group."""
    plain = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"))
    return _beside(plain, keys, by_index(df, keys, value, {"p50": 0.5, "p95": 0.95}), keep=True)


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of the least-squares line of each group of more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).filter("n > 1")


def accuracy(df: DataFrame, keys: list[str], is_correct: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.avg(is_correct.cast("double")) * 100).alias("accuracy"))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles by linear interpolation and whiskers: the outermost values within 1.5 quartile ranges."""
    q = quantiles(df, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = _beside(df, keys, q).filter(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*keys, "q1", "q2", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def similarity_matrix(vectors: DataFrame, kind: str = "float") -> DataFrame:
    """i, j and score of all ordered pairs of a registry (columns `name`, `embedding`): a set that is bounded by nature.

    The registry is counted, travels as one array in a single row, and is read by every row of it.
    """
    vectors = vectors.select("name", "embedding")
    if vectors.limit(MOST_COMPARED + 1).count() > MOST_COMPARED:
        raise ValueError(f"more than {MOST_COMPARED} vectors to compare with each other")
    whole = F.broadcast(vectors.agg(F.collect_list(F.struct("name", "embedding")).alias("all")))
    pairs = vectors.join(whole).select("name", "embedding", F.explode("all").alias("b"))
    return pairs.select(F.col("name").alias("i"), F.col("b.name").alias("j"), cosine(F.col("embedding"), F.col("b.embedding"), kind).alias("score"))


def thresholds(sweep: tuple[float, float, int] = SWEEP) -> Column:
    first, step, n = sweep
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(first) + i * F.lit((first + step) - first))


def threshold_sweep(scored: DataFrame, sweep: tuple[float, float, int] = SWEEP) -> DataFrame:
    """Confusion counts and ratios at each threshold; scored has expected, best_intent and best_score.

    Rows are counted by their score and kind first, so what is expanded by the thresholds is the number of different
    scores, and then summed by threshold.
    """
    should = F.col("expected") != ""
    right = F.coalesce(F.col("best_intent") == F.col("expected"), F.lit(False))
    kinds = scored.select(should.alias("should"), right.alias("right"), F.col("best_score").alias("s")).groupBy("should", "right", "s").agg(F.count(F.lit(1)).alias("n"))
    at = kinds.select("*", F.explode(thresholds(sweep)).alias("threshold"))
    hit = F.coalesce(F.col("s") >= F.col("threshold"), F.lit(False))
    counts = at.groupBy("threshold").agg(
        F.sum(F.when(F.col("should") & hit & F.col("right"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("should") & ~hit, F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when(~F.col("should") & ~hit, F.col("n")).otherwise(0)).alias("tn"),
        F.sum(F.when(hit & ~(F.col("should") & F.col("right")), F.col("n")).otherwise(0)).alias("fp"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    rated = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", ratio(2 * p * r, p + r))


def best_f1(sweep: DataFrame, configured: float) -> DataFrame:
    """The first threshold with the highest F1 (chart), and the same with the configured one if every F1 is 0 (dashboard)."""
    best = sweep.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("chart"), F.max("f1").alias("f1"))
    return best.withColumn("dashboard", F.when(F.col("f1") == 0, F.lit(configured)).otherwise(F.col("chart")))


def summary(df: DataFrame) -> DataFrame:
    """One row over all results: columns avg_us, p50_us, p95_us, correct, matched, score."""
    matched_score = F.when(F.col("matched"), F.col("score"))
    plain = df.agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("long")).alias("n_correct"), (F.avg(F.col("correct").cast("double")) * 100).alias("accuracy"), F.avg("avg_us").alias("mean_us"),
        F.sum(F.col("matched").cast("long")).alias("n_matched"), F.avg(matched_score).alias("mean_score"), F.min(matched_score).alias("min_score"), F.max(matched_score).alias("max_score"),
        F.coalesce(F.try_divide(F.lit(1e6), F.avg("avg_us")), F.lit(0.0)).alias("per_second"),
    )
    return _beside(_beside(plain, [], quantiles(df, [], "p50_us", {"p50_us": 0.5}), keep=True), [], quantiles(df, [], "p95_us", {"p95_us": 0.95}), keep=True)


def api_comparison(df: DataFrame) -> DataFrame:
    """Mean local ms against each service's round trip, with the speed-up; 0 if the mean is not positive."""
    rows = F.array(*[F.struct(F.lit(k).alias("service"), F.lit(v).alias("round_trip_ms")) for k, v in ROUND_TRIPS.items()])
    local = df.agg((F.avg("avg_us") / 1000).alias("local_ms"))
    out = local.select("local_ms", F.explode(rows).alias("r")).select("r.service", "r.round_trip_ms", "local_ms")
    return out.withColumn("speedup", F.when(F.col("local_ms") > 0, F.col("round_trip_ms") / F.when(F.col("local_ms") > 0, F.col("local_ms"))).otherwise(0.0))


def scores_by_intent(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The best score per intent name in a map; pairs has the keys, name and score."""
    top = pairs.groupBy(*keys, "name").agg(F.max("score").alias("score"))
    return top.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "score")))).alias("scores"))
