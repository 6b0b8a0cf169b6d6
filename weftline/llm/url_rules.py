"""Operator 1: URL filter by a written rule list and by association rules mined from its decisions.

The list decides first: a rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's
path, and the longest rule wins. URLs that no rule fits are judged by mined rules. A transaction is the set of a URL's
tokens (host labels, top-level domain, path segments, query keys; digits in a token are written 0) with the item BLOCK if
its label says so. Spark's FP-growth finds the frequent token sets; the rules {tokens} -> BLOCK with enough support and
confidence are kept, less those whose tokens contain a smaller kept rule. They are matched by an inverted index: token ->
rules, counting for each distinct token set how many of a rule's tokens it holds.

Mining takes at most `most_rows` labelled URLs (the documented bound, in the order of the URLs' XXH64) with all their tokens,
but for those under the support, which are in no frequent set. So that one long URL repeated often does not give 2^n
frequent sets, tokens that occur in exactly the same rows are one item in mining; a rule over items stands for the rules over
every choice of their tokens, which are those that mining the single tokens would give. Judging takes every URL with all its
tokens.

Defined cases: a null URL or one without `://` has empty host, path and token set and is allowed; repeated rows are judged
each; with no blocked URL, or none frequent enough, nothing is mined and the verdict is allow. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, small

#: verdict, host, path: the list of the query.
LIST = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BLOCK = "=block"
#: At a confidence of 0.7 or 0.8 rules spread to pages that the list leaves alone, without finding more that it blocks (README).
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
MOST_ROWS = 50_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def tokens_of(url: Column) -> Column:
    """The sorted distinct tokens of a URL."""
    host, path, query = host_of(url), path_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3)
    marked = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(_lower(x), "[0-9]+", "0")))
    labels = F.split(host, "\\.", -1)
    keys = F.transform(F.split(query, "&", -1), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_sort(F.array_distinct(F.concat(marked("h:", labels), marked("t:", F.slice(labels, -1, 1)), marked("p:", F.split(path, "/", -1)), marked("q:", keys))))


def by_list(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (with host and path) and the longest fitting rule: rule, rule_verdict, null where none fits.

    rules has verdict, host, path. Rules are looked up once for each distinct host under all its suffixes, then each
    page takes the longest one whose path fits.
    """
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"))
    asked = pages.select("host").filter("host <> ''").distinct().select("host", F.explode(suffixes).alias("suffix"))
    fits = asked.join(small(named), "suffix").groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "rule_path", "rule_verdict")).alias("fits"))
    joined = pages.join(small(fits), "host", "left")
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return joined.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.rule_verdict")).drop("fits", "best")


def _items(counted: DataFrame, least: int) -> DataFrame:
    """item (its first token) and members of each class of tokens (row, token) that occur in the same rows, `least` at the least.

    Sets of rows are compared by their size and two hashes of 64 bits.
    """
    marks = [F.bit_xor(F.xxhash64("row", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    sets = counted.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks).filter(F.col("n") >= least)
    return sets.groupBy("n", "x1", "x2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")).select("item", "members")


def _spelled_out(rules: DataFrame, items: DataFrame) -> DataFrame:
    """rules over items as rules over every choice of their members."""
    of = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("item")).join(items, "item")
    listed = of.groupBy("tokens", "confidence", "support").agg(F.collect_list("members").alias("lists"))
    every = F.aggregate("lists", F.array(F.array().cast("array<string>")), lambda done, own: F.flatten(F.transform(done, lambda d: F.transform(own, lambda t: F.concat(d, F.array(t))))))
    return listed.select(F.explode(every).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most_rows: int = MOST_ROWS) -> DataFrame:
    """tokens, confidence, support of the kept rules; labelled has url and blocked (boolean)."""
    rows = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull()).orderBy(F.xxhash64("url"), "url", "blocked").limit(most_rows)
    rows = cut(rows.select(tokens_of(F.col("url")).alias("tokens"), "blocked").withColumn("row", F.monotonically_increasing_id()))
    counted = rows.select("row", F.explode("tokens").alias("token"))
    items = cut(_items(counted, math.ceil(min_support * rows.count())))
    named = items.select("item", F.explode("members").alias("token"))
    held = counted.join(small(named), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    baskets = rows.select("row", "blocked").join(held, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), label).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(cut(baskets)).associationRules
    ruled = found.filter(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    kept = cut(ruled.filter((F.size("tokens") > 0) & F.col("confidence").isNotNull()))
    # Less a rule that holds all items of a smaller one: found by the same kind of index.
    index, parts = _index(kept), kept.select("tokens", F.explode("tokens").alias("token"))
    larger = parts.join(index, "token").groupBy("tokens", "rule", "size").count().filter((F.col("count") == F.col("size")) & (F.size("tokens") > F.col("size"))).select("tokens").distinct()
    return _spelled_out(kept.join(larger, "tokens", "left_anti"), items)


def _index(rules: DataFrame) -> DataFrame:
    """The inverted index: token, rule (its tokens in a string) and the rule's size."""
    return rules.select(F.explode("tokens").alias("token"), F.array_join("tokens", " ").alias("rule"), F.size("tokens").alias("size"))


def by_mined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (with tokens) and mined: whether some rule's tokens are all among the page's."""
    index = _index(rules)
    sets = pages.select(F.array_join("tokens", " ").alias("key"), "tokens").distinct()
    counted = sets.select("key", F.explode("tokens").alias("token")).join(small(index), "token").groupBy("key", "rule", "size").count()
    hit = counted.filter(F.col("count") == F.col("size")).select("key").distinct().withColumn("mined", F.lit(True))
    return pages.withColumn("key", F.array_join("tokens", " ")).join(hit, "key", "left").withColumn("mined", F.coalesce("mined", F.lit(False))).drop("key")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict and mined of every page.

    labelled (url, blocked) has the labels that are mined. Without any, the labels are the list's own decisions: a page that
    the list blocks is blocked, every other page, undecided ones included, is not, so that a combination needs most of its
    pages blocked by the list.
    """
    url = F.col("url")
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    listed = cut(by_list(parsed, rules))
    if labelled is None:
        labelled = listed.select("url", (F.coalesce("rule_verdict", F.lit("allow")) == "block").alias("blocked"))
    mined_rules = mine(labelled, **mining)
    judged = by_mined(listed.withColumn("tokens", tokens_of(url)), cut(mined_rules))
    verdict = F.coalesce("rule_verdict", F.when(F.col("mined"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined")


def _oracle() -> str:
    up, low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    part = lambda n: rf"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', {n})"
    marked = lambda mark, parts: f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{mark}:' || regexp_replace(translate(x, {up}, {low}), '[0-9]+', '0', 'g'))"
    keys = "list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^[^=]*'))"
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in LIST)
    return f"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, url, translate({part(1)}, {up}, {low}) AS host, {part(2)} AS path, {part(3)} AS query FROM pages),
r(verdict, host, path) AS (VALUES {listed}),
f AS (SELECT k, max({{'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': verdict}}) AS best FROM p JOIN r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY k),
t AS (SELECT p.*, best.rule AS rule, best.verdict AS listed, list_sort(list_distinct(list_concat({marked('h', "string_split(host, '.')")}, {marked('t', "string_split(host, '.')[-1:]")},
  {marked('p', "string_split(path, '/')")}, {marked('q', keys)}))) AS tokens FROM p LEFT JOIN f ON p.k = f.k),
total AS (SELECT count(*) AS n FROM t WHERE url IS NOT NULL),
s AS (SELECT tokens, count(*) AS n, count(*) FILTER (listed = 'block') AS bad FROM t WHERE url IS NOT NULL GROUP BY tokens),
m AS (SELECT tokens, n, bad, unnest(range(1, (1 << len(tokens))::BIGINT)) AS mask FROM s WHERE len(tokens) > 0),
c AS (SELECT tokens, n, bad, array_to_string(list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1), ' ') AS part FROM m),
rules AS (SELECT part FROM c GROUP BY part HAVING sum(bad) >= ceil({MIN_SUPPORT}::DOUBLE * (SELECT n FROM total)) AND sum(bad)::DOUBLE / sum(n) >= {MIN_CONFIDENCE}::DOUBLE),
hit AS (SELECT DISTINCT tokens FROM c WHERE part IN (SELECT part FROM rules))
SELECT page_id, host, path, rule, coalesce(listed, CASE WHEN hit.tokens IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, hit.tokens IS NOT NULL AS mined
FROM t LEFT JOIN hit ON t.tokens = hit.tokens
"""


#: The same by counting every set of tokens of every URL, for tables that mining takes whole (MOST_ROWS).
ORACLE = _oracle()
