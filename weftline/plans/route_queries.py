"""Queries of similarity, routing, message logs, payloads and whole sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..operators import evaluate, memory, prompt
from ..operators.embed import HashingProvider
from ..operators.route import EARLY_EXIT, THRESHOLD, Registry, route, route_vectors as match_vectors, score_intents
from . import oracles as O, session
from .text_queries import _read

SIZE = 64
SYSTEM = "You are a helpful AI assistant."


def _examples(spark, sf_dir, per_label: int) -> DataFrame:
    """The first vectors of each label as registered examples."""
    vectors = _read(spark, sf_dir, "embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return vectors.withColumn("r", rank).filter(F.col("r") <= per_label).select(F.col("vec_id").alias("reg_ord"), F.concat(F.lit("INTENT_"), "label").alias("name"), "embedding")


def _rounded(score, digits: int):
    """A single-precision score as a rounded double."""
    return F.round(F.col(score).cast("double"), digits)


def _or(col, value, name: str | None = None):
    """The column with a plain value where there was no match, since results are compared as text."""
    return F.coalesce(col, F.lit(value)).alias(name or col)


def cosine_pairs(spark, sf_dir):
    registry = Registry.of(_examples(spark, sf_dir, 1))
    scored = score_intents(_read(spark, sf_dir, "embeddings"), registry)
    return scored.select("vec_id", F.explode("scores").alias("name", "s")).select("vec_id", "name", _rounded("s", 4).alias("score"))


def intent_similarity_matrix(spark, sf_dir):
    return evaluate.similarity_matrix(_examples(spark, sf_dir, 1)).withColumn("score", _rounded("score", 3))


def max_score_per_intent(spark, sf_dir):
    scored = score_intents(_read(spark, sf_dir, "embeddings"), Registry.of(_examples(spark, sf_dir, 5)))
    return scored.select("vec_id", F.explode("scores").alias("name", "s")).select("vec_id", "name", _rounded("s", 4).alias("score"))


def _best(scored: DataFrame) -> DataFrame:
    """The best intent of each map of scores; of equal ones the first by name."""
    top = F.array_max(F.transform(F.map_entries("scores"), lambda e: e["value"]))
    first = F.array_min(F.transform(F.filter(F.map_entries("scores"), lambda e: e["value"] == top), lambda e: e["key"]))
    return scored.withColumn("best_score", top).withColumn("best_intent", first)


def best_intent(spark, sf_dir):
    scored = score_intents(_read(spark, sf_dir, "embeddings"), Registry.of(_examples(spark, sf_dir, 5)))
    return _best(scored).select("vec_id", "best_intent", _rounded("best_score", 4).alias("best_score"))


def scores_pivot(spark, sf_dir):
    scored = score_intents(_read(spark, sf_dir, "embeddings"), Registry.of(_examples(spark, sf_dir, 5)))
    return scored.select("vec_id", *[F.round(F.coalesce(F.col("scores")[f"INTENT_{i}"].cast("double"), F.lit(0.0)), 4).alias(f"intent_{i}") for i in range(10)])


def route_vectors(spark, sf_dir):
    routed = match_vectors(_read(spark, sf_dir, "embeddings"), Registry.of(_examples(spark, sf_dir, 5)))
    return routed.select("vec_id", _or("intent_name", ""), _or(_rounded("score", 4), -1.0, "score"))


def _text_registry(spark, sf_dir, provider) -> Registry:
    """All benchmark items as examples, with their whole texts, under eight names."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("reg_ord"), F.concat(F.lit("INTENT_"), F.col("item_id") % 8).alias("name"), T.sanitize(F.col("text")).alias("example"))
    return Registry.of(items, provider)


def _user_turns(spark, sf_dir) -> DataFrame:
    """User turns, every fifth one of which ends the session."""
    users = _read(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, " QUIT\t").otherwise(F.col("text")).alias("text"))


def route_text(spark, sf_dir):
    provider = HashingProvider(SIZE)
    users = _read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.sanitize(F.col("text")).alias("sanitized"))
    routed = route(users, _text_registry(spark, sf_dir, provider), provider)
    return routed.select("conv_id", "turn", "sanitized", _or("route.intent_name", "", "intent_name"), _or(_rounded("route.score", 6), -1.0, "score"), _or("route.ord", -1, "phrase_ord"))


def _log(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), "role", F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("ts"))


def _shown(history):
    return F.md5(F.encode(F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"), "utf-8"))


def recent_history(spark, sf_dir):
    found = memory.history_before(_log(spark, sf_dir), 3)
    return found.select("conv_id", F.col("id").alias("turn"), F.size("history").alias("n_history"), _shown(F.col("history")).alias("history_md5"))


def last_messages(spark, sf_dir):
    found = memory.recent(_log(spark, sf_dir), 5)
    return found.select("conv_id", F.size("history").alias("n_history"), _shown(F.col("history")).alias("history_md5"))


def chronological_last_k(spark, sf_dir):
    return memory.latest_of_log(_log(spark, sf_dir), 10).select("conv_id", "id", "role", "content")


def prune_keep_latest(spark, sf_dir):
    return memory.prune(_log(spark, sf_dir), 3).select("conv_id", "id", "role", "content")


def update_last_message(spark, sf_dir):
    return memory.update_last(_log(spark, sf_dir), F.lit("updated")).select("conv_id", "id", "role", "content")


def append_message(spark, sf_dir):
    log = _log(spark, sf_dir)
    new = log.select("conv_id").distinct().select("conv_id", F.lit(0).alias("ord"), F.lit("user").alias("role"), F.lit("one more; '--").alias("content"))
    return memory.append(log, new).select("conv_id", "id", "role", "content")


def clear_history(spark, sf_dir):
    """Numbering goes on after a log was cleared."""
    log = _log(spark, sf_dir)
    empty, water = memory.clear(log)
    new = water.select("conv_id", F.lit(0).alias("ord"), F.lit("user").alias("role"), F.lit("again").alias("content"))
    return memory.append(empty, new, water).select("conv_id", "id", "role", "content")


def session_cut(spark, sf_dir):
    return session.session_cut(session.sanitized(_user_turns(spark, sf_dir))).select("conv_id", "turn", "sanitized")


def _parsed(payload, path: str | None = None):
    found = F.from_json(payload if path is None else F.get_json_object(payload, path), prompt.MESSAGE)
    shown = F.array_join(F.transform(found, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return F.size(found).alias("n_messages"), F.array_join(F.transform(found, lambda m: m["role"]), ",").alias("roles"), F.md5(F.encode(shown, "utf-8")).alias("messages_md5")


def payload_messages(spark, sf_dir):
    turns = memory.history_before(_log(spark, sf_dir), 3).filter("role = 'user'")
    made = turns.withColumn("payload", prompt.payload(SYSTEM, T.sanitize(F.col("content")), F.when(F.col("id") % 2 == 0, F.lit("some <context>")).otherwise(""), F.col("history")))
    return made.select("conv_id", F.col("id").alias("turn"), *_parsed(F.col("payload")))


def payload_api(spark, sf_dir):
    turns = _log(spark, sf_dir).filter("role = 'user'")
    made = turns.withColumn("payload", prompt.api_payload(SYSTEM, T.sanitize(F.col("content")), F.lit(""), None, "some-model", 0.7, 256))
    option = lambda k: F.get_json_object("payload", f"$.{k}")
    return made.select("conv_id", F.col("id").alias("turn"), *_parsed(F.col("payload"), "$.messages"), option("model").alias("model"), F.round(option("temperature").cast("double"), 9).alias("temperature"), option("max_tokens").cast("int").alias("max_tokens"))


def session_replay(spark, sf_dir):
    provider = HashingProvider(SIZE)
    done = session.replay(_user_turns(spark, sf_dir), _text_registry(spark, sf_dir, provider), provider, SYSTEM, 3)
    matched = F.col("route").isNotNull()
    return done.select("conv_id", "turn", matched.alias("matched"), _or("action", ""), F.size("history").alias("n_history"), _shown(F.col("history")).alias("history_md5"), F.when(~matched, F.size(F.from_json("payload", prompt.MESSAGE))).otherwise(0).alias("n_messages"))


_EX = "examples AS (SELECT vec_id AS reg_ord, 'INTENT_' || label AS name, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= {n})"
_PAIRS = f"pairs AS (SELECT v.vec_id, x.reg_ord, x.name, {O.cosine('v.embedding', 'x.e')} AS s FROM embeddings v, examples x)"
_TOP = "top AS (SELECT vec_id, name, max(s) AS s FROM pairs GROUP BY vec_id, name)"
_WITH = f"WITH {_EX.format(n=5)}, {_PAIRS}, {_TOP}"
_LOG = "(SELECT conv_id, turn AS id, role, text AS content FROM conversations)"
_HIST = "array_to_string(list_transform({h}, lambda m: m.role || ':' || m.content), chr(10))"
_TURNS = f"(SELECT conv_id, turn, {O.sanitize('t')} AS s FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' QUIT' || chr(9) ELSE text END AS t FROM conversations WHERE role = 'user'))"
_CUT = f"cut AS (SELECT conv_id, turn, s FROM {_TURNS} t WHERE s <> '' AND NOT EXISTS (SELECT 1 FROM {_TURNS} q WHERE q.conv_id = t.conv_id AND q.turn <= t.turn AND q.s IN ('quit', 'exit')))"
_BEFORE = "coalesce(list({{'role': role, 'content': content}}) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), [])".replace("{{", "{").replace("}}", "}")
_CONTENT = "CASE WHEN id % 2 = 0 THEN 'Use the following context to answer the question:' || chr(10) || chr(10) || '<context>some <context></context>' || chr(10) || chr(10) || 'Question: ' || c ELSE c END"

QUERIES = {f.__name__: f for f in (cosine_pairs, intent_similarity_matrix, max_score_per_intent, best_intent, scores_pivot, route_vectors, route_text, recent_history, last_messages, chronological_last_k, prune_keep_latest, update_last_message, append_message, clear_history, session_cut, payload_messages, payload_api, session_replay)}

ORACLES = {
    "cosine_pairs": f"WITH {_EX.format(n=1)}, {_PAIRS} SELECT vec_id, name, round(s::DOUBLE, 4) + 0.0::DOUBLE AS score FROM pairs",
    "intent_similarity_matrix": f"WITH {_EX.format(n=1)} SELECT a.name AS i, b.name AS j, round({O.cosine('a.e', 'b.e')}::DOUBLE, 3) + 0.0::DOUBLE AS score FROM examples a, examples b",
    "max_score_per_intent": f"{_WITH} SELECT vec_id, name, round(s::DOUBLE, 4) + 0.0::DOUBLE AS score FROM top",
    "best_intent": f"{_WITH} SELECT vec_id, name AS best_intent, round(s::DOUBLE, 4) + 0.0::DOUBLE AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, name) AS r FROM top) WHERE r = 1",
    "scores_pivot": f"{_WITH} SELECT vec_id, " + ", ".join(f"round(coalesce(max(CASE WHEN name = 'INTENT_{i}' THEN s END)::DOUBLE, 0.0), 4) + 0.0::DOUBLE AS intent_{i}" for i in range(10)) + " FROM top GROUP BY vec_id",
    "route_vectors": f"{_WITH}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, reg_ord) AS r FROM pairs) WHERE r = 1) SELECT vec_id, CASE WHEN s >= {THRESHOLD}::FLOAT THEN name ELSE '' END AS intent_name, CASE WHEN s >= {THRESHOLD}::FLOAT THEN round(s::DOUBLE, 4) ELSE -1 END AS score FROM b",
    "route_text": f"""WITH src AS (SELECT conv_id * 1000 + turn AS k, {O.sanitize('text')} AS "full" FROM conversations WHERE role = 'user'),
{O.routed('src', 'k', T.STOP_WORDS, THRESHOLD, EARLY_EXIT, SIZE)}
SELECT src.k // 1000 AS conv_id, src.k % 1000 AS turn, "full" AS sanitized, coalesce(intent_name, '') AS intent_name, coalesce(round(score::DOUBLE, 6), -1) AS score, coalesce(ord, -1)::INT AS phrase_ord FROM src LEFT JOIN routes USING (k)""",
    "recent_history": f"SELECT conv_id, id AS turn, len(h)::INT AS n_history, md5({_HIST.format(h='h')}) AS history_md5 FROM (SELECT conv_id, id, {_BEFORE} AS h FROM {_LOG})",
    "last_messages": f"SELECT conv_id, count(*)::INT AS n_history, md5(string_agg(role || ':' || content, chr(10) ORDER BY id)) AS history_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS r FROM {_LOG}) WHERE r <= 5 GROUP BY conv_id",
    "chronological_last_k": f"SELECT * FROM {_LOG} ORDER BY conv_id DESC, id DESC LIMIT 10",
    "prune_keep_latest": f"SELECT conv_id, id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS r FROM {_LOG}) WHERE r <= 3",
    "update_last_message": f"SELECT conv_id, id, role, CASE WHEN id = max(id) OVER (PARTITION BY conv_id) THEN 'updated' ELSE content END AS content FROM {_LOG}",
    "append_message": f"SELECT * FROM {_LOG} UNION ALL SELECT conv_id, max(id) + 1, 'user', 'one more; ''--' FROM {_LOG} GROUP BY conv_id",
    "clear_history": f"SELECT conv_id, max(id) + 1 AS id, 'user' AS role, 'again' AS content FROM {_LOG} GROUP BY conv_id",
    "session_cut": f"WITH {_CUT} SELECT conv_id, turn, s AS sanitized FROM cut",
    "payload_messages": f"""SELECT conv_id, id AS turn, (len(h) + 2)::INT AS n_messages, array_to_string(list_concat(['system'], list_transform(h, lambda m: m.role), ['user']), ',') AS roles,
md5('system:{SYSTEM}' || chr(10) || CASE WHEN len(h) > 0 THEN {_HIST.format(h='h')} || chr(10) ELSE '' END || 'user:' || {_CONTENT}) AS messages_md5
FROM (SELECT conv_id, id, role, {O.sanitize('content')} AS c, {_BEFORE} AS h FROM {_LOG}) WHERE role = 'user'""",
    "payload_api": f"""SELECT conv_id, id AS turn, 2 AS n_messages, 'system,user' AS roles, md5('system:{SYSTEM}' || chr(10) || 'user:' || {O.sanitize('content')}) AS messages_md5,
'some-model' AS model, round(0.7::FLOAT::DOUBLE, 9) AS temperature, 256 AS max_tokens FROM {_LOG} WHERE role = 'user'""",
    "session_replay": f"""WITH {_CUT}, src AS (SELECT conv_id * 1000 + turn AS k, s AS "full" FROM cut),
{O.routed('src', 'k', T.STOP_WORDS, THRESHOLD, EARLY_EXIT, SIZE)},
said AS (SELECT k // 1000 AS conv_id, k % 1000 AS turn, "full", intent_name FROM src LEFT JOIN routes USING (k)),
log AS (SELECT conv_id, 2 * turn AS id, 'user' AS role, "full" AS content FROM said UNION ALL SELECT conv_id, 2 * turn + 1, 'assistant', 'Executed local action: ' || intent_name FROM said WHERE intent_name IS NOT NULL),
seen AS (SELECT conv_id, id, {_BEFORE} AS h FROM log)
SELECT said.conv_id, turn, intent_name IS NOT NULL AS matched, coalesce('Executed local action: ' || intent_name, '') AS action, len(h)::INT AS n_history, md5({_HIST.format(h='h')}) AS history_md5,
CASE WHEN intent_name IS NULL THEN (len(h) + 2)::INT ELSE 0 END AS n_messages FROM said JOIN seen ON seen.conv_id = said.conv_id AND seen.id = 2 * turn""",
}
