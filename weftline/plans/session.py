"""A batch of sessions: turns in, routed actions and prompt payloads out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..operators import prompt
from ..operators.context import fetched_context, url_context
from ..operators.memory import history_before
from ..operators.route import THRESHOLD, Registry, route

STOP_AT = ("quit", "exit")


def sanitized(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """turns with `sanitized`, without those that have no words."""
    return turns.withColumn("sanitized", T.sanitize(F.col(text_col))).filter(F.col("sanitized") != "")


def session_cut(turns: DataFrame) -> DataFrame:
    """The turns of each conversation before its first quit or exit (columns conv_id, turn, sanitized).

    The first end of each conversation is an aggregate of few rows that is joined back; no conversation is gathered.
    """
    ends = turns.filter(F.col("sanitized").isin(*STOP_AT)).groupBy("conv_id").agg(F.min("turn").alias("__end"))
    return turns.join(ends, "conv_id", "left").filter(F.col("__end").isNull() | (F.col("turn") < F.col("__end"))).drop("__end")


def log_of(routed: DataFrame) -> DataFrame:
    """The messages that routed turns leave: the turn itself, and the action's text after a match.

    id orders the messages of a conversation: 2 * turn, and one more for an action.
    """
    said = F.struct((2 * F.col("turn")).alias("id"), F.lit("user").alias("role"), F.col("sanitized").alias("content"))
    done = F.struct((2 * F.col("turn") + 1).alias("id"), F.lit("assistant").alias("role"), T.action_text(F.col("route.intent_name")).alias("content"))
    rows = F.when(F.col("route").isNotNull(), F.array(said, done)).otherwise(F.array(said))
    return routed.select("conv_id", "turn", F.col("route").isNotNull().alias("matched"), F.explode(rows).alias("m")).select("conv_id", "turn", "matched", "m.*")


def replay(turns: DataFrame, registry: Registry | None = None, provider=None, system: str = "You are a helpful AI assistant.", history_limit: int = 10, threshold: float = THRESHOLD, bodies: DataFrame | None = None, model: str | None = None, temperature: float | None = None, max_tokens: int | None = None, fetcher=None) -> DataFrame:
    """Every turn (conv_id, turn, text) that has words and comes before its session's end, with what happens to it.

    Columns: conv_id, turn, sanitized, route (null unless matched), action (for a match), history, context and payload
    (else). The context of turns without a match comes from the links of their text: out of `bodies` (url, body), or read by
    `fetcher`, a function of a URL. Pruning a log to twice the history limit never reaches the messages that a history shows, so the history is a
    window of `history_limit` messages.
    """
    kept = session_cut(sanitized(turns))
    routed = route(kept, registry or Registry(), provider, threshold)
    if bodies is not None:
        routed = url_context(routed.withColumn("__key", F.struct("conv_id", "turn")), bodies, "__key", "text").drop("__key")
    elif fetcher is not None:
        routed = fetched_context(routed, "text", F.col("route").isNull(), fetcher).drop("failed")
    else:
        routed = routed.withColumn("context", F.lit(""))
    log = history_before(log_of(routed), history_limit).filter(F.col("role") == "user").filter(F.col("id") % 2 == 0).select("conv_id", "turn", "history")
    joined = routed.join(log, ["conv_id", "turn"])
    options = (F.col("context"), F.col("history"))
    made = prompt.api_payload(system, F.col("sanitized"), *options, model, temperature, max_tokens) if model else prompt.payload(system, F.col("sanitized"), *options)
    matched = F.col("route").isNotNull()
    return joined.select("conv_id", "turn", "sanitized", "route", F.when(matched, T.action_text(F.col("route.intent_name"))).alias("action"), "context", "history", F.when(~matched, made).alias("payload"))


def final_log(log: DataFrame, history_limit: int) -> DataFrame:
    """What is left of the logs after their sessions: a log is pruned to twice the history limit after each turn that
    does not match, never after one that does."""
    numbered = log.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("id")))
    last = numbered.filter(~F.col("matched")).groupBy("conv_id").agg(F.max("n").alias("__last"))
    return numbered.join(last, "conv_id", "left").filter(F.col("__last").isNull() | (F.col("n") > F.col("__last") - 2 * history_limit)).select("conv_id", "id", "role", "content")


def run_actions(routed: DataFrame, action) -> None:
    """Gives the matched rows to `action`, a function of a DataFrame, as a sink does with a batch."""
    action(routed.filter(F.col("route").isNotNull()))
