"""Queries of the text functions, tokenizing and URL context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import context, tokenize
from . import oracles as O


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sanitize_conversations(spark, sf_dir):
    clean = _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.sanitize(F.col("text")).alias("sanitized"))
    return clean.filter("sanitized <> ''").withColumn("word_count", T.word_count(F.col("sanitized")))


def sanitize_documents(spark, sf_dir):
    clean = _read(spark, sf_dir, "documents").select("doc_id", T.sanitize(F.col("text")).alias("sanitized"))
    return clean.filter("sanitized <> ''").withColumn("word_count", T.word_count(F.col("sanitized")))


def basic_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.basic_tokens(F.col("text"))).alias("pos", "token"))


def basic_token_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(T.basic_tokens(F.col("text"))).alias("n_tokens"))


def stopword_filter(spark, sf_dir):
    of = T.words(T.sanitize(F.col("text")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.without_stop_words(of), " ").alias("kept"), F.size(T.without_stop_words(of)).alias("n_kept"))


def ngram_windows(spark, sf_dir):
    users = _read(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", F.posexplode(T.phrases(T.sanitize(F.col("text")))).alias("ord", "phrase"))


def _linking(spark, sf_dir):
    """Texts that hold links: no text of the tables does, so each page's URL is put in one."""
    return _read(spark, sf_dir, "pages").select("page_id", "url", "html", F.concat(F.lit("see ("), "url", F.lit("), and "), "url", F.lit(". HTTP://no")).alias("text"))


def extract_urls(spark, sf_dir):
    return _linking(spark, sf_dir).select("page_id", F.posexplode(T.extract_urls(F.col("text"))).alias("pos", "found"))


def url_context(spark, sf_dir):
    pages = _linking(spark, sf_dir)
    found = context.url_context(pages, pages.groupBy("url").agg(F.min("html").alias("body")), "page_id", "text")
    return found.select("page_id", F.length("context").alias("n_chars"), F.md5(F.encode("context", "utf-8")).alias("context_md5"))


def _vocabulary(spark, sf_dir):
    """A vocabulary made from the benchmark: beginnings and inner pieces of its words of even length, numbered by their hashes."""
    of = _read(spark, sf_dir, "benchmark").select(F.explode(T.basic_tokens(F.col("text"))).alias("w")).distinct().filter("length(w) % 2 = 0")
    at = F.sequence(F.lit(2), F.length("w"))
    parts = F.concat(F.array(F.substring("w", 1, 1), F.substring("w", 1, 3)), F.transform(at, lambda p: F.concat(F.lit("##"), F.substring(F.col("w"), p, F.lit(1)))), F.transform(at, lambda p: F.concat(F.lit("##"), F.substring(F.col("w"), p, F.lit(2)))))
    tokens = of.select(F.explode(parts).alias("token")).distinct()
    return tokens.withColumn("token_id", F.conv(F.substring(F.md5(F.encode("token", "utf-8")), 1, 7), 16, 10).cast("long") + 1000)


def wordpiece_ids(spark, sf_dir):
    vocabulary = tokenize.Vocabulary.of(_vocabulary(spark, sf_dir))
    ids = tokenize.encode(_read(spark, sf_dir, "benchmark"), vocabulary, "item_id", "text")
    return ids.select("item_id", F.size("ids").alias("token_count"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def wordpiece_counts(spark, sf_dir):
    vocabulary = tokenize.Vocabulary.of(_vocabulary(spark, sf_dir))
    users = _read(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return tokenize.encode(users, vocabulary, "key", "text").select("key", F.size("ids").alias("token_count"))


_VOCAB = f"""
bw AS (SELECT DISTINCT unnest(regexp_extract_all({O.lower("text")}, {O.TOKEN})) AS w FROM benchmark),
ew AS (SELECT w FROM bw WHERE length(w) % 2 = 0),
parts AS (SELECT substr(w, 1, 1) AS token FROM ew UNION SELECT substr(w, 1, 3) FROM ew
  UNION SELECT '##' || substr(w, p, 1) FROM ew, LATERAL (SELECT unnest(range(2, length(w) + 1)) AS p)
  UNION SELECT '##' || substr(w, p, 2) FROM ew, LATERAL (SELECT unnest(range(2, length(w) + 1)) AS p)),
vocab AS (SELECT token, ('0x' || substr(md5(token), 1, 7))::BIGINT + 1000 AS id FROM parts)"""


def _pieces(source: str, key: str) -> str:
    return f"""WITH RECURSIVE {_VOCAB},
placed AS (SELECT {key}, unnest(range(len(ts))) AS pos, unnest(ts) AS word FROM (SELECT {key}, regexp_extract_all({O.lower("text")}, {O.TOKEN}) AS ts FROM {source})),
ws AS (SELECT DISTINCT word FROM placed),
sub AS (SELECT word, i, j FROM ws, LATERAL (SELECT unnest(range(0, length(word))) AS i), LATERAL (SELECT unnest(range(i + 1, least(length(word), i + 5) + 1)) AS j) WHERE strlen(word) <= 200),
hit AS (SELECT word, i, max(j) AS j, arg_max(id, j) AS id FROM sub JOIN vocab ON token = CASE WHEN i > 0 THEN '##' ELSE '' END || substr(word, i + 1, j - i) GROUP BY word, i),
walk(word, spot, ids, stuck) AS (SELECT word, 0::BIGINT, []::BIGINT[], false FROM ws
  UNION ALL SELECT k.word, coalesce(h.j, k.spot), list_append(k.ids, coalesce(h.id, 100)), h.id IS NULL FROM walk k LEFT JOIN hit h ON h.word = k.word AND h.i = k.spot WHERE NOT k.stuck AND k.spot < length(k.word)),
cut AS (SELECT word, ids FROM walk WHERE stuck OR spot >= length(word)),
joined AS (SELECT {key}, list_slice(flatten(list(ids ORDER BY pos)), 1, 510) AS ids FROM placed JOIN cut USING (word) GROUP BY {key}),
done AS (SELECT s.{key}, list_concat([101], coalesce(ids, []), [102]) AS ids FROM {source} s LEFT JOIN joined USING ({key}))"""


_LINKS = "(SELECT page_id, url, html, 'see (' || url || '), and ' || url || '. HTTP://no' AS text FROM pages)"
_STOP = T.STOP_WORDS

QUERIES = {f.__name__: f for f in (sanitize_conversations, sanitize_documents, basic_tokens, basic_token_counts, stopword_filter, ngram_windows, extract_urls, url_context, wordpiece_ids, wordpiece_counts)}

ORACLES = {
    "sanitize_conversations": f"SELECT conv_id, turn, sanitized, len({O.words('sanitized')})::INT AS word_count FROM (SELECT conv_id, turn, {O.sanitize('text')} AS sanitized FROM conversations) WHERE sanitized <> ''",
    "sanitize_documents": f"SELECT doc_id, sanitized, len({O.words('sanitized')})::INT AS word_count FROM (SELECT doc_id, {O.sanitize('text')} AS sanitized FROM documents) WHERE sanitized <> ''",
    "basic_tokens": f"SELECT item_id, unnest(range(len(ts)))::INT AS pos, unnest(ts) AS token FROM (SELECT item_id, regexp_extract_all({O.lower('text')}, {O.TOKEN}) AS ts FROM benchmark)",
    "basic_token_counts": f"SELECT doc_id, len(regexp_extract_all({O.lower('text')}, {O.TOKEN}))::INT AS n_tokens FROM documents",
    "stopword_filter": f"SELECT conv_id, turn, array_to_string(kw, ' ') AS kept, len(kw)::INT AS n_kept FROM (SELECT conv_id, turn, {O.kept(O.words(O.sanitize('text')), _STOP)} AS kw FROM conversations)",
    "ngram_windows": f"""WITH src AS (SELECT conv_id * 1000 + turn AS k, {O.sanitize('text')} AS "full" FROM conversations WHERE role = 'user'),
{O.phrases('src', 'k', _STOP)} SELECT k // 1000 AS conv_id, k % 1000 AS turn, ord::INT AS ord, phrase FROM tried""",
    "extract_urls": f"SELECT page_id, unnest(range(len(us)))::INT AS pos, unnest(us) AS found FROM (SELECT page_id, {O.urls('text')} AS us FROM {_LINKS})",
    "url_context": f"""WITH l AS (SELECT page_id, unnest(range(len(us))) AS pos, unnest(us) AS u FROM (SELECT page_id, {O.urls('text')} AS us FROM {_LINKS})),
b AS (SELECT url, min(html) AS body FROM pages GROUP BY url),
c AS (SELECT page_id, string_agg(body, '' ORDER BY pos) AS context FROM l JOIN b ON u = url WHERE strlen(body) <= 10485760 GROUP BY page_id)
SELECT p.page_id, length(coalesce(context, ''))::INT AS n_chars, md5(coalesce(context, '')) AS context_md5 FROM pages p LEFT JOIN c USING (page_id)""",
    "wordpiece_ids": _pieces("benchmark", "item_id") + " SELECT item_id, len(ids)::INT AS token_count, array_to_string(ids, ' ') AS ids FROM done",
    "wordpiece_counts": _pieces("(SELECT conv_id || ':' || turn AS key, text FROM conversations WHERE role = 'user')", "key") + " SELECT key, len(ids)::INT AS token_count FROM done",
}
