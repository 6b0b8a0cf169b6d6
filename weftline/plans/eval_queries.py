"""Queries of the evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate
from ..operators.route import THRESHOLD, Registry, score_intents
from . import route_queries as R
from .text_queries import _read


def latency_stats_by_category(spark, sf_dir):
    """Event values as latencies, event types as categories."""
    stats = evaluate.latency_stats(_read(spark, sf_dir, "events"), ["event_type"], "value")
    return stats.select("event_type", "n", F.round("avg", 4).alias("avg"), "min", "max", F.round("std", 4).alias("std"), "p50", "p95")


def latency_trend(spark, sf_dir):
    lines = evaluate.trend(_read(spark, sf_dir, "events"), ["event_type"], "user_id", "value")
    return lines.select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _scored(spark, sf_dir):
    """Vectors with their label's name as the expected intent; vectors of label 0 should match nothing."""
    registry = Registry.of(R._examples(spark, sf_dir, 2).filter("name <> 'INTENT_0'"))
    expected = F.when(F.col("label") == 0, "").otherwise(F.concat(F.lit("INTENT_"), "label"))
    scored = R._best(score_intents(_read(spark, sf_dir, "embeddings"), registry))
    return scored.select("vec_id", "label", expected.alias("expected"), "best_intent", R._rounded("best_score", 6).alias("best_score"))


def _results(spark, sf_dir):
    matched = F.col("best_score") >= THRESHOLD
    rows = _scored(spark, sf_dir).withColumn("matched", matched)
    return rows.withColumn("correct", evaluate.correct(F.col("expected"), F.col("matched"), F.col("best_intent")))


def accuracy_by_category(spark, sf_dir):
    return evaluate.accuracy(_results(spark, sf_dir), ["label"], F.col("correct")).withColumn("accuracy", F.round("accuracy", 4))


def threshold_sweep(spark, sf_dir):
    sweep = evaluate.threshold_sweep(_scored(spark, sf_dir))
    return sweep.select("threshold", "tp", "fn", "tn", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


def best_f1(spark, sf_dir):
    return evaluate.best_f1(evaluate.threshold_sweep(_scored(spark, sf_dir)), THRESHOLD).select("chart", "dashboard", F.round("f1", 6).alias("f1"))


def summary_dashboard(spark, sf_dir):
    """Results with latencies made from the vector's number, as a real run would have measured."""
    us = F.col("vec_id") % 97 + 100
    rows = _results(spark, sf_dir).select("matched", "correct", F.col("best_score").alias("score"), (us * 1.5).alias("avg_us"), us.alias("p50_us"), (us * 3).alias("p95_us"))
    found = evaluate.summary(rows)
    return found.select("total", "n_correct", "n_matched", *[F.round(c, 4).alias(c) for c in ("accuracy", "mean_us", "p50_us", "p95_us", "mean_score", "min_score", "max_score", "per_second")])


def api_comparison(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 97 + 100.5).alias("avg_us"))
    return evaluate.api_comparison(rows).select("service", "round_trip_ms", F.round("local_ms", 6).alias("local_ms"), F.round("speedup", 3).alias("speedup"))


def score_distribution(spark, sf_dir):
    """Best scores by the quality label of the vector's number; vectors without one are of category unknown."""
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.concat(F.lit("quality "), "quality").alias("category"))
    rows = _scored(spark, sf_dir).join(labels, "vec_id", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    found = evaluate.distribution(rows, ["category"], "best_score")
    return found.select("category", *[F.round(c, 5).alias(c) for c in ("q1", "q2", "q3", "low", "high")])


def example_counts(spark, sf_dir):
    examples = R._examples(spark, sf_dir, 5)
    return examples.groupBy(F.replace("name", F.lit("INTENT_"), F.lit("")).alias("intent")).agg(F.count(F.lit(1)).alias("n_examples"))


def action_lines(spark, sf_dir):
    """The lines that matched texts print, and their intents' short labels."""
    routed = R.route_text(spark, sf_dir).filter("intent_name <> ''")
    return routed.select("conv_id", "turn", T.action_line(F.col("intent_name"), F.col("score")).alias("line"), T.action_text(F.col("intent_name")).alias("action"), T.short_label(F.concat(F.lit("ACTION_"), "sanitized")).alias("label"))


_SCORED = f"""WITH {R._EX.format(n=2)}, {R._PAIRS}, {R._TOP},
bst AS (SELECT vec_id, name AS best_intent, round(s::DOUBLE, 6) AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, name) AS r FROM top WHERE name <> 'INTENT_0') WHERE r = 1),
scored AS (SELECT vec_id, label, CASE WHEN label = 0 THEN '' ELSE 'INTENT_' || label END AS expected, best_intent, best_score FROM embeddings JOIN bst USING (vec_id)),
results AS (SELECT *, best_score >= {THRESHOLD} AS matched, CASE WHEN expected = '' THEN best_score < {THRESHOLD} ELSE best_score >= {THRESHOLD} AND best_intent = expected END AS correct FROM scored)"""
_SWEEP = """,
grid AS (SELECT 0.40::DOUBLE + i::DOUBLE * ((0.40::DOUBLE + 0.02::DOUBLE) - 0.40::DOUBLE) AS threshold FROM range(28) AS g(i)),
counts AS (SELECT threshold, count(*) FILTER (expected <> '' AND best_score >= threshold AND best_intent = expected) AS tp,
  count(*) FILTER (expected <> '' AND best_score < threshold) AS fn, count(*) FILTER (expected = '' AND best_score < threshold) AS tn,
  count(*) FILTER (best_score >= threshold AND NOT (expected <> '' AND best_intent = expected)) AS fp FROM scored, grid GROUP BY threshold),
ratios AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS a FROM counts),
rated AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM ratios)"""
_ROUTED = f"""WITH src AS (SELECT conv_id * 1000 + turn AS k, {R.O.sanitize('text')} AS "full" FROM conversations WHERE role = 'user'),
{R.O.routed('src', 'k', T.STOP_WORDS, THRESHOLD, R.EARLY_EXIT, R.SIZE)}"""

QUERIES = {f.__name__: f for f in (latency_stats_by_category, latency_trend, accuracy_by_category, threshold_sweep, best_f1, summary_dashboard, api_comparison, score_distribution, example_counts, action_lines)}

ORACLES = {
    "latency_stats_by_category": """SELECT event_type, n, round(a, 4) AS avg, mn AS min, mx AS max, round(sd, 4) AS std, l[(n // 2) + 1] AS p50, l[floor(n * 0.95)::BIGINT + 1] AS p95
FROM (SELECT event_type, count(value) AS n, avg(value) AS a, min(value) AS mn, max(value) AS mx, stddev_pop(value) AS sd, list_sort(list(value)) AS l FROM events GROUP BY event_type)""",
    "latency_trend": "SELECT event_type, count(*) AS n, round(regr_slope(value, user_id), 6) AS slope, round(regr_intercept(value, user_id), 4) AS intercept FROM events GROUP BY event_type HAVING count(*) > 1",
    "accuracy_by_category": f"{_SCORED} SELECT label, count(*) AS n, round(avg(correct::INT::DOUBLE) * 100, 4) AS accuracy FROM results GROUP BY label",
    "threshold_sweep": f"{_SCORED}{_SWEEP} SELECT threshold, tp, fn, tn, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(a, 6) AS accuracy, round(f, 6) AS f1 FROM rated",
    "best_f1": f"{_SCORED}{_SWEEP}, top_f AS (SELECT * FROM rated ORDER BY f DESC, threshold LIMIT 1) SELECT threshold AS chart, CASE WHEN f = 0 THEN {THRESHOLD}::DOUBLE ELSE threshold END AS dashboard, round(f, 6) AS f1 FROM top_f",
    "summary_dashboard": f"""{_SCORED}, m AS (SELECT *, vec_id % 97 + 100 AS us, CASE WHEN matched THEN best_score END AS ms FROM results)
SELECT count(*) AS total, sum(correct::INT)::BIGINT AS n_correct, sum(matched::INT)::BIGINT AS n_matched, round(avg(correct::INT::DOUBLE) * 100, 4) AS accuracy, round(avg(us * 1.5::DOUBLE), 4) AS mean_us,
round(quantile_cont(us::DOUBLE, 0.5), 4) AS p50_us, round(quantile_cont((us * 3)::DOUBLE, 0.95), 4) AS p95_us, round(avg(ms), 4) AS mean_score, round(min(ms), 4) AS min_score, round(max(ms), 4) AS max_score,
round(1e6 / avg(us * 1.5::DOUBLE), 4) AS per_second FROM m""",
    "api_comparison": """WITH l AS (SELECT avg(vec_id % 97 + 100.5::DOUBLE) / 1000 AS ms FROM embeddings),
s(service, rt) AS (VALUES ('GPT-3.5 Turbo', 300.0::DOUBLE), ('GPT-4o', 800.0::DOUBLE), ('Claude 3 Sonnet', 600.0::DOUBLE), ('Local Llama 3', 2000.0::DOUBLE))
SELECT service, rt AS round_trip_ms, round(ms, 6) AS local_ms, round(rt / ms, 3) AS speedup FROM s, l""",
    "score_distribution": f"""{_SCORED}, c AS (SELECT coalesce('quality ' || quality, 'unknown') AS category, best_score AS s FROM scored LEFT JOIN labels ON doc_id = vec_id),
q AS (SELECT category, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS q2, quantile_cont(s, 0.75) AS q3 FROM c GROUP BY category)
SELECT category, round(q1, 5) AS q1, round(q2, 5) AS q2, round(q3, 5) AS q3, round(min(s), 5) AS low, round(max(s), 5) AS high
FROM c JOIN q USING (category) WHERE s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY category, q1, q2, q3""",
    "example_counts": "SELECT label::VARCHAR AS intent, count(*) AS n_examples FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 5 GROUP BY label",
    "action_lines": f"""{_ROUTED} SELECT src.k // 1000 AS conv_id, src.k % 1000 AS turn, '[ACTION] ' || intent_name || ' (score: ' || round(score::DOUBLE, 6)::VARCHAR || ')' AS line, 'Executed local action: ' || intent_name AS action,
CASE WHEN length("full") > 42 THEN substr("full", 1, 42) || '…' ELSE "full" END AS label FROM src JOIN routes USING (k)""",
}
