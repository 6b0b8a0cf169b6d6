"""A benchmark's tables: timings in, the document of all results and the data behind each chart out.

results: category, input, sanitized, expected_intent, matched, matched_intent, score, correct, word_count and the timing
columns avg_us, min_us, max_us, p50_us, p95_us. similarity: input, expected_intent, best_intent, best_score, scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import evaluate

CATEGORIES = ["direct_command", "noisy_command", "complex_sentence", "no_match", "edge_case"]


def timings(runs: DataFrame, key: str = "input", us: str = "us") -> DataFrame:
    """avg_us, min_us, max_us, p50_us and p95_us of each input's runs."""
    stats = evaluate.latency_stats(runs.withColumn(us, F.col(us).cast("double")), [key], us)
    return stats.select(key, F.col("avg").alias("avg_us"), F.col("min").alias("min_us"), F.col("max").alias("max_us"), F.col("p50").alias("p50_us"), F.col("p95").alias("p95_us"))


def results(routed: DataFrame, times: DataFrame) -> DataFrame:
    """routed (category, input, sanitized, expected_intent, route) judged and joined with its timings."""
    matched = F.col("route").isNotNull()
    intent = F.col("route.intent_name")
    judged = routed.select("category", "input", "sanitized", "expected_intent", matched.alias("matched"), intent.alias("matched_intent"), F.col("route.score").alias("score"), evaluate.correct(F.col("expected_intent"), matched, intent).alias("correct"), T.word_count(F.col("sanitized")).alias("word_count"))
    return judged.join(times, "input")


def in_order(df: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """Rows of the known categories with their place in the charts."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    return df.withColumn("place", place).filter("place > 0")


def charts(results: DataFrame, similarity: DataFrame, matrix: DataFrame, embedding: DataFrame, tokenizing: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """The data of every chart. embedding and tokenizing: input, word_count and timing columns."""
    ms = lambda c: (F.col(c) / 1000).alias(c.replace("_us", "_ms"))
    bars = lambda df: df.select("input", "word_count", ms("avg_us"), ((F.col("avg_us") - F.col("min_us")) / 1000).alias("below"), ((F.col("max_us") - F.col("avg_us")) / 1000).alias("above"))
    # An input that occurs twice counts with its last category, as in a dictionary filled in order.
    category = results.groupBy("input").agg(F.max("category").alias("category"))
    scored = similarity.join(category, "input", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    by_category = results.groupBy("category").agg((F.avg("avg_us") / 1000).alias("mean_ms"), (F.stddev_pop("avg_us") / 1000).alias("std_ms"))
    sweep = evaluate.threshold_sweep(similarity.select(F.col("expected_intent").alias("expected"), "best_intent", "best_score"))
    lines = evaluate.trend(results.withColumn("all", F.lit("all")), ["all"], "word_count", "avg_us")
    return {
        "latency_by_category": in_order(by_category),
        "latency_by_words": results.select("category", "word_count", ms("avg_us")),
        "latency_trend": lines,
        "accuracy_by_category": in_order(evaluate.accuracy(results, ["category"], F.col("correct"))),
        "score_distribution": evaluate.distribution(scored, ["category"], "best_score"),
        "similarity_matrix": matrix.withColumn("i", T.short_label(F.col("i"))).withColumn("j", T.short_label(F.col("j"))),
        "threshold_sweep": sweep,
        "best_threshold": evaluate.best_f1(sweep, threshold),
        "embedding_latency": bars(embedding),
        "tokenizing_latency": tokenizing.select("input", "word_count", ms("avg_us"), "token_count") if "token_count" in tokenizing.columns else tokenizing.select("input", "word_count", ms("avg_us")),
        "api_comparison": evaluate.api_comparison(results),
        "scores_by_input": similarity.select(T.short_label(F.col("input")).alias("input"), F.explode("scores").alias("intent", "score")),
        "summary": evaluate.summary(results),
    }


def charts_of(document: DataFrame) -> dict[str, DataFrame]:
    """The data of every chart out of a result document (see sources.files.load_results)."""
    from ..sources.files import sections

    parts = sections(document)
    latency = ["avg_us", "min_us", "max_us", "p50_us", "p95_us"]
    found = parts["routing_results"]
    results = found.select(*[c for c in found.columns if c != "latency"], *[F.col(f"latency.{c}").alias(c) for c in latency]) if "latency" in found.columns else found
    similar = parts["similarity_results"]
    names = [f.name for f in similar.schema["scores_by_intent"].dataType.fields]
    scores = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"scores_by_intent.`{n}`").cast("double") for n in names])), lambda _, x: x.isNotNull())
    similarity = similar.withColumn("scores", scores).drop("scores_by_intent")
    whole = document.select("similarity_matrix.*")
    rows = whole.select("labels", F.posexplode("matrix").alias("a", "row")).select("labels", "a", F.posexplode("row").alias("b", "score"))
    matrix = rows.select(F.element_at("labels", F.col("a") + 1).alias("i"), F.element_at("labels", F.col("b") + 1).alias("j"), "score")
    threshold = document.select(F.col("config.threshold")).first()[0]
    return charts(results, similarity, matrix, parts["embedding_latency"], parts["tokenization_latency"], threshold)


def run_all(parts: dict[str, DataFrame], path: str) -> None:
    """Writes the document's tables and the charts' data as JSON lines below path."""
    from ..sources.files import write_results

    write_results(parts, path)


def main(argv: list[str] | None = None) -> int:
    """`python -m weftline.plans.report RESULTS FOLDER`: the data of all charts of a result document; exit code 1 on failure."""
    import sys

    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from ..sources.files import load_results

    given = sys.argv[1:] if argv is None else argv
    if len(given) != 2:
        print("usage: report RESULTS FOLDER", file=sys.stderr)
        return 1
    try:
        spark = SparkSession.builder.appName("report").getOrCreate()
        run_all(charts_of(load_results(spark, given[0])), given[1])
    except (OSError, ValueError, KeyError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
