"""Operator 9: quality rules on documents and on their hosts, with DataFrame functions only.

A document's counts follow from its whole text (null counts as empty). Hosts are the values of the host column. For each
rule the failures are summed by host, each host's rate is shrunk towards all hosts by a beta prior whose two parameters
come from the mean and variance of the hosts' rates (method of moments), and a host whose shrunk rate of some rule is
above `host_limit` fails. The verdict is joined back: a document is kept if it passes the base rules and its host passes.

Defined cases: a null host is no host and fails nobody; rows that repeat are judged and counted each; an empty table gives
no rows; a single host, or hosts of equal rates, get the strongest prior. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, small

WHITE = " \t\n\x0b\f\r"
WHITE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: rule -> (counted part, percent of which whole); a document fails the rule beyond it.
RULES = {"repeats": ("n_repeat_words", 20, "n_words"), "symbols": ("n_symbols", 10, "word_chars"), "lines": ("n_dup_lines", 30, "n_lines")}
LEAST_WORDS = 10
HOST_LIMIT = 0.5
WEAKEST, STRONGEST = 1.0, 1000.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        def flagged(ordered: Column) -> Column:
            same = lambda s, i: F.coalesce(F.get(ordered, i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == s["h"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(ordered, same), lambda s: s["i"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, flagged))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, covered))


def measures(text: Column) -> Column:
    """A struct of the counts of a text."""
    text = F.coalesce(text, F.lit(""))

    def of_text(t: Column) -> Column:
        bare = F.btrim(t, F.lit(WHITE))
        words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN, -1))
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
        of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).cast("long").alias("n_repeat_words"))
        of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
        return F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))

    return let(text, of_text)


def _exceeds(rule: str) -> Column:
    part, percent, whole = RULES[rule]
    return 100 * F.col(part) > percent * F.col(whole)


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the counts, base_failed and one fail_<rule> column for each rule."""
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m"))
    flat = measured.select("doc_id", "host", "m.w.*", "m.l.*", "m.n_symbols")
    judged = flat.withColumn("fail_words", F.col("n_words") < LEAST_WORDS)
    for rule in RULES:
        judged = judged.withColumn(f"fail_{rule}", _exceeds(rule))
    return judged.withColumn("base_failed", F.col("fail_words") | F.col("fail_repeats"))


def judge_hosts(judged: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, rule, n, fails, shrunk (posterior mean rate) and host_failed; a row for each host and rule."""
    names = ["words", *RULES]
    sums = judged.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(r) for r in names])
    long = sums.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("fails")) for r in names])).alias("x")).select("host", "n", "x.*")
    rated = long.withColumn("rate", F.col("fails") / F.col("n"))
    moments = rated.groupBy("rule").agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("spread"))
    strength = F.when(F.col("spread") > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.col("mean") * (1 - F.col("mean")) / F.when(F.col("spread") > 0, F.col("spread")) - 1))).otherwise(STRONGEST)
    priors = moments.select("rule", (F.col("mean") * strength).alias("alpha"), strength.alias("strength"))
    shrunk = (F.col("fails") + F.col("alpha")) / (F.col("n") + F.col("strength"))
    return rated.join(F.broadcast(priors), "rule").select("host", "rule", "n", "fails", shrunk.alias("shrunk"), (shrunk > host_limit).alias("host_failed"))


def quality(docs: DataFrame, host_limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every row's counts with base_failed, host_failed and kept.

    The texts are measured once; the rows of counts are cut, summed by host (partial sums before the shuffle) and joined
    with the hosts that fail. Those are broadcast if they are few, else joined by Spark, which splits a hot host.
    """
    judged = cut(judge_documents(docs, id_col, text_col, host_col))
    failing = judge_hosts(judged, host_limit).filter("host_failed").select("host").distinct().withColumn("host_failed", F.lit(True))
    joined = judged.join(small(failing), "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, host, t, list_filter(regexp_split_to_array(t, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \t\n\v\f\r]+', '', 'g') <> '') AS ls FROM d),
g AS (SELECT k, i, list_slice(ws, i, i + 4) AS gram FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM r, range(0, 5) AS v(j) GROUP BY k),
m AS (SELECT w.k, doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c ON w.k = c.k),
j AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 100 * n_symbols > 10 * word_chars AS f3,
  100 * n_dup_lines > 30 * n_lines AS f4 FROM m),
s AS (SELECT host, count(*) AS n, [sum(f1::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT)] AS f FROM j WHERE host IS NOT NULL GROUP BY host),
l AS (SELECT host, n, rule, f[rule] AS fails, f[rule]::DOUBLE / n AS rate FROM s, range(1, 5) AS q(rule)),
p AS (SELECT rule, avg(rate) AS mean, CASE WHEN var_pop(rate) > 0
  THEN least(1000.0, greatest(1.0, avg(rate) * (1 - avg(rate)) / var_pop(rate) - 1)) ELSE 1000.0 END AS strength FROM l GROUP BY rule),
b AS (SELECT DISTINCT host FROM l JOIN p USING (rule) WHERE (fails + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, f1 OR f2 AS base_failed,
  b.host IS NOT NULL AS host_failed, NOT (f1 OR f2) AND b.host IS NULL AS kept
FROM j LEFT JOIN b ON j.host = b.host
"""
