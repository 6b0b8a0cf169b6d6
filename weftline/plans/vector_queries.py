"""Queries of vector functions, registries that change, truncation and chart data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T, vectors as V
from ..operators import evaluate, memory, tokenize
from ..operators.embed import HashingProvider
from ..operators.route import THRESHOLD, Registry, route, route_vectors
from ..sources.config import parse_config
from . import oracles as O, report, route_queries as R, session
from .text_queries import _pieces, _read, _vocabulary

#: Vectors that are pooled together, as a text's tokens are.
POOLED = 8
CATEGORIES = ["purchase", "click", "view"]


def remove_intent(spark, sf_dir):
    """Routing after all examples of one name were dropped from the registry."""
    registry = Registry.of(R._examples(spark, sf_dir, 5))
    registry.remove("INTENT_3")
    registry.remove("no such name")
    routed = route_vectors(_read(spark, sf_dir, "embeddings"), registry)
    return routed.select("vec_id", R._or("intent_name", ""), R._or(R._rounded("score", 4), -1.0, "score"))


def clear_intents(spark, sf_dir):
    """An empty registry routes no text."""
    provider = HashingProvider(R.SIZE)
    registry = R._text_registry(spark, sf_dir, provider)
    registry.clear()
    users = _read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.sanitize(F.col("text")).alias("sanitized"))
    return route(users, registry, provider).select("conv_id", "turn", F.col("route").isNull().alias("unmatched"))


def routing_off(spark, sf_dir):
    """Without a provider every text goes unmatched, whatever is registered."""
    registry = R._text_registry(spark, sf_dir, HashingProvider(R.SIZE))
    users = _read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.sanitize(F.col("text")).alias("sanitized"))
    return route(users, registry, None).select("conv_id", "turn", F.col("route").isNull().alias("unmatched"))


def matched_turns(spark, sf_dir):
    """What the action of a session is given: its matched turns, once each."""
    provider, given = HashingProvider(R.SIZE), []
    session.run_actions(session.replay(R._user_turns(spark, sf_dir), R._text_registry(spark, sf_dir, provider), provider, R.SYSTEM, 3), given.append)
    return given[0].select("conv_id", "turn", F.col("route.intent_name").alias("intent_name"), "action")


def append_timestamps(spark, sf_dir):
    """Appended messages have a time, those of the log before keep theirs (none in these tables)."""
    log = R._log(spark, sf_dir)
    new = log.select("conv_id").distinct().select("conv_id", F.lit(0).alias("ord"), F.lit("user").alias("role"), F.lit("now").alias("content"))
    return memory.append(log, new).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_timed"))


#: Configurations and what becomes of them: the name of the error, or the values of three settings.
CONFIGS = [
    ("{}", "", "0.65", 10, ""), ('{"whatever": [1]}', "", "0.65", 10, ""), ('{"similarity_threshold": 0.5, "history_limit": 3, "api_model": "m"}', "", "0.5", 3, "m"), ('{"history_limit": 2.9}', "", "0.65", 2, ""),
    ('{"api_model": 5, "api_temperature": "hot"}', "", "0.65", 10, ""), ("{", "RuntimeError", "", 0, ""), ("[1]", "RuntimeError", "", 0, ""), ('{"model_path": ""}', "ValueError", "", 0, ""), ('{"db_path": ""}', "ValueError", "", 0, ""),
    ('{"similarity_threshold": 1.5}', "ValueError", "", 0, ""), ('{"similarity_threshold": "x"}', "TypeError", "", 0, ""), ('{"history_limit": 0}', "ValueError", "", 0, ""), ('{"api_temperature": 2.5}', "ValueError", "", 0, ""),
    ('{"api_max_tokens": 0}', "ValueError", "", 0, ""), ('{"intents": [{"example": "x"}]}', "ValueError", "", 0, ""), ('{"intents": [{"name": "n"}]}', "ValueError", "", 0, ""), ('{"intents": [{"name": "n", "examples": []}]}', "ValueError", "", 0, ""),
]


def config_rules(spark, sf_dir):
    """Every rule of the configuration, on a document that keeps or breaks it."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                try:
                    c = parse_config(text)
                    out.append(("", f"{c.similarity_threshold:g}", c.history_limit, c.api_model or ""))
                except (RuntimeError, ValueError, TypeError) as e:
                    out.append((type(e).__name__, "", 0, ""))
            yield pd.DataFrame(out, columns=["error", "threshold", "history_limit", "model"])

    documents = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CONFIGS)], "i int, text string")
    return documents.select("i", F.pandas_udf(read, "error string, threshold string, history_limit int, model string")("text").alias("c")).select("i", "c.*")


def vector_cosine(spark, sf_dir):
    """Each vector with the next one, in single precision."""
    v = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return v.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("after")).cast("double"), 6).alias("score"))


def rounded_scores(spark, sf_dir):
    """The same, rounded in single precision and printed as a double."""
    v = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    score = V.round_float(V.cosine(F.col("embedding"), F.col("after")), 4)
    return v.join(after, "vec_id").select("vec_id", F.round(V.float_as_json_number(score), 8).alias("score"))


def _long(df, *keys):
    return df.select(*keys, F.posexplode("v").alias("pos", "x")).select(*keys, "pos", F.round(F.col("x").cast("double"), 7).alias("x"))


def l2_normalised(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x * F.lit(3).cast("float")).cast("float"))
    return _long(_read(spark, sf_dir, "embeddings").withColumn("v", V.l2_normalise(scaled)), "vec_id")


def mean_pooled(spark, sf_dir):
    """Eight vectors at a time, as the token vectors of a text."""
    v = _read(spark, sf_dir, "embeddings").withColumn("group_id", F.floor(F.col("vec_id") / POOLED).cast("long"))
    rows = v.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    return _long(rows.withColumn("v", V.mean_pool(F.transform("rows", lambda r: r["embedding"]))), "group_id")


def error_bars(spark, sf_dir):
    """Mean with the distances to the least and the greatest value, in thousandths, as chart data has them."""
    stats = evaluate.latency_stats(_read(spark, sf_dir, "events"), ["event_type"], "value")
    bar = lambda c: F.round(c / 1000, 6)
    return stats.select("event_type", bar(F.col("avg")).alias("avg_ms"), bar(F.col("avg") - F.col("min")).alias("below"), bar(F.col("max") - F.col("avg")).alias("above"))


def category_order(spark, sf_dir):
    """The known categories with their place in charts; others are left out."""
    counts = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return report.in_order(counts, CATEGORIES).select("category", "n", F.col("place").cast("int").alias("place"))


def event_quartiles(spark, sf_dir):
    found = evaluate.distribution(_read(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", *[F.round(c, 5).alias(c) for c in ("q1", "q2", "q3", "low", "high")])


def _coded(ids):
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").cast("binary"))


def wordpiece_documents(spark, sf_dir):
    """All documents, cut to the longest input of a model."""
    ids = tokenize.encode(_read(spark, sf_dir, "documents"), tokenize.Vocabulary.of(_vocabulary(spark, sf_dir)), "doc_id", "text")
    return ids.select("doc_id", F.size("ids").alias("token_count"), _coded("ids").alias("ids_md5"))


def truncated_ids(spark, sf_dir):
    """Twelve ids at most, the marks at both ends included."""
    ids = tokenize.encode(_read(spark, sf_dir, "benchmark"), tokenize.Vocabulary.of(_vocabulary(spark, sf_dir)), "item_id", "text", 12)
    return ids.select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def special_ids(spark, sf_dir):
    """The marks of a vocabulary that names none of them, and of one that names all."""
    of = [tokenize.Vocabulary.of(v) for v in (_vocabulary(spark, sf_dir), spark.createDataFrame([("[CLS]", 1), ("[SEP]", 2), ("[UNK]", 3)], "token string, token_id long"))]
    return spark.createDataFrame([(i, v.cls, v.sep, v.unk) for i, v in enumerate(of)], "vocabulary int, cls int, sep int, unk int")


def document_token_counts(spark, sf_dir):
    """How often each basic token occurs in all documents."""
    tokens = _read(spark, sf_dir, "documents").select(F.explode(T.basic_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def model_paths(spark, sf_dir):
    """Which of the names are models in the other format; every second page's name gets its ending."""
    name = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".ort").otherwise(".onnx"))
    return _read(spark, sf_dir, "pages").select("page_id", T.is_ort_model(name).alias("is_ort"))


_NEXT = f"SELECT a.vec_id, {O.cosine('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_DOT = "list_reduce(list_transform({v}, lambda x: x * x), lambda s, t: s + t)"
_DOCUMENT_WORDS = f"regexp_extract_all({O.lower('text')}, {O.TOKEN})"

QUERIES = {f.__name__: f for f in (remove_intent, clear_intents, routing_off, matched_turns, append_timestamps, config_rules, vector_cosine, rounded_scores, l2_normalised, mean_pooled, error_bars, category_order, event_quartiles, wordpiece_documents, truncated_ids, special_ids, document_token_counts, model_paths)}

ORACLES = {
    "remove_intent": f"WITH {R._EX.format(n=5)}, {R._PAIRS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, reg_ord) AS r FROM pairs WHERE name <> 'INTENT_3') WHERE r = 1) SELECT vec_id, CASE WHEN s >= {THRESHOLD}::FLOAT THEN name ELSE '' END AS intent_name, CASE WHEN s >= {THRESHOLD}::FLOAT THEN round(s::DOUBLE, 4) ELSE -1 END AS score FROM b",
    "clear_intents": "SELECT conv_id, turn, true AS unmatched FROM conversations WHERE role = 'user'",
    "routing_off": "SELECT conv_id, turn, true AS unmatched FROM conversations WHERE role = 'user'",
    "matched_turns": f"""WITH {R._CUT}, src AS (SELECT conv_id * 1000 + turn AS k, s AS "full" FROM cut),
{O.routed('src', 'k', T.STOP_WORDS, THRESHOLD, R.EARLY_EXIT, R.SIZE)}
SELECT k // 1000 AS conv_id, k % 1000 AS turn, intent_name, 'Executed local action: ' || intent_name AS action FROM routes""",
    "append_timestamps": "SELECT conv_id, count(*) + 1 AS n, 1::BIGINT AS n_timed FROM conversations GROUP BY conv_id",
    "config_rules": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{e}', '{t}', {h}, '{m}')" for i, (_, e, t, h, m) in enumerate(CONFIGS)) + ") AS v(i, error, threshold, history_limit, model)",
    "vector_cosine": f"SELECT vec_id, round(s::DOUBLE, 6) + 0.0::DOUBLE AS score FROM ({_NEXT})",
    "rounded_scores": f"SELECT vec_id, round((round(s * 10000::FLOAT)::FLOAT / 10000::FLOAT)::FLOAT::DOUBLE, 8) + 0.0::DOUBLE AS score FROM ({_NEXT})",
    "l2_normalised": f"""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3::FLOAT)::FLOAT) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt({_DOT.format(v='v')})::FLOAT AS norm FROM t)
SELECT vec_id, (p - 1)::INT AS pos, round((v[p] / norm)::DOUBLE, 7) + 0.0::DOUBLE AS x FROM n, range(1, 65) AS g(p)""",
    "mean_pooled": f"""WITH t AS (SELECT vec_id // {POOLED} AS group_id, vec_id, p, embedding[p] AS x FROM embeddings, range(1, 65) AS g(p)),
m AS (SELECT group_id, p, (list_reduce(list(x ORDER BY vec_id), lambda s, y: s + y) / count(*)::FLOAT)::FLOAT AS x FROM t GROUP BY group_id, p),
n AS (SELECT group_id, list(x ORDER BY p) AS v FROM m GROUP BY group_id), o AS (SELECT group_id, v, sqrt({_DOT.format(v='v')})::FLOAT AS norm FROM n)
SELECT group_id, (p - 1)::INT AS pos, round((v[p] / norm)::DOUBLE, 7) + 0.0::DOUBLE AS x FROM o, range(1, 65) AS g(p)""",
    "error_bars": "SELECT event_type, round(avg(value) / 1000, 6) AS avg_ms, round((avg(value) - min(value)) / 1000, 6) AS below, round((max(value) - avg(value)) / 1000, 6) AS above FROM events GROUP BY event_type",
    "category_order": f"SELECT event_type AS category, count(*) AS n, list_position({CATEGORIES}, event_type)::INT AS place FROM events WHERE event_type IN {tuple(CATEGORIES)} GROUP BY event_type",
    "event_quartiles": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, round(q1, 5) AS q1, round(q2, 5) AS q2, round(q3, 5) AS q3, round(min(value), 5) AS low, round(max(value), 5) AS high
FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY event_type, q1, q2, q3""",
    "wordpiece_documents": _pieces("documents", "doc_id") + " SELECT doc_id, len(ids)::INT AS token_count, md5(array_to_string(ids, ' ')) AS ids_md5 FROM done",
    "truncated_ids": _pieces("benchmark", "item_id") + " SELECT item_id, array_to_string(list_concat(ids[1:least(11, len(ids) - 1)], [102]), ' ') AS ids FROM done",
    "special_ids": "SELECT * FROM (VALUES (0, 101, 102, 100), (1, 1, 2, 3)) AS v(vocabulary, cls, sep, unk)",
    "document_token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({_DOCUMENT_WORDS}) AS token FROM documents) GROUP BY token",
    "model_paths": "SELECT page_id, page_id % 2 = 0 AS is_ort FROM pages",
}
