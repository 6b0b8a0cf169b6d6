"""Sessions as a stream: cleaning and routing without state, and the latest messages of each conversation kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import prompt
from ..operators.context import fetched_context
from ..operators.route import THRESHOLD, Registry, route
from ..plans.session import STOP_AT, sanitized

OUT = "conv_id long, turn long, sanitized string, intent_name string, score float, context string, history array<struct<role:string,content:string>>"
STATE = "roles array<string>, contents array<string>, ended boolean"


def with_history(turns: DataFrame, history_limit: int = 10, idle_ms: int | None = None, registry: Registry | None = None, provider=None, threshold: float = THRESHOLD, fetcher=None) -> DataFrame:
    """A stream of turns (conv_id, turn, text) with their routes and the messages before each one.

    A conversation's turns are taken in order of `turn` within a micro-batch and in order of arrival across them. The state
    is the last 2 * history_limit messages, so it is bounded; a matched turn leaves its action as well. After quit or exit
    nothing more comes out. With idle_ms, conversations without turns for so long are forgotten. With a fetcher, a function of a URL, the links of turns
    without a match are read into `context`.
    """
    keep = 2 * history_limit

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        roles, contents, ended = state.get if state.exists else ([], [], False)
        log = list(zip(roles, contents))
        rows = []
        batch = [r for pdf in pdfs for r in pdf[["turn", "sanitized", "intent_name", "score", "context"]].itertuples(index=False)]
        for turn, said, intent, score, context in sorted(batch, key=lambda r: (int(r[0]), r[1])):
            if ended or said in STOP_AT:
                ended = True
                continue
            matched = isinstance(intent, str)
            shown = log[-history_limit:] if history_limit else []
            rows.append((int(key[0]), int(turn), said, intent if matched else None, score if matched else None, "" if matched else context, [{"role": r, "content": c} for r, c in shown]))
            log.append(("user", said))
            if matched:
                log.append(("assistant", f"Executed local action: {intent}"))
            log = log[-keep:] if keep else []
        state.update(([r for r, _ in log], [c for _, c in log], ended))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if rows:
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "sanitized", "intent_name", "score", "context", "history"])

    routed = route(sanitized(turns), registry or Registry(), provider, threshold)
    routed = routed.withColumn("context", F.lit("")) if fetcher is None else fetched_context(routed, "text", F.col("route").isNull(), fetcher)
    clean = routed.select("conv_id", "turn", "sanitized", F.col("route.intent_name").alias("intent_name"), F.col("route.score").alias("score"), "context")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return clean.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", timeout)


def results(turns: DataFrame, system: str = "You are a helpful AI assistant.", **options) -> DataFrame:
    """with_history, with the action of matched turns and the prompt payload of the others."""
    out = with_history(turns, **options)
    matched = F.col("intent_name").isNotNull()
    return out.withColumn("action", F.when(matched, T.action_text(F.col("intent_name")))).withColumn("payload", F.when(~matched, prompt.payload(system, F.col("sanitized"), F.col("context"), F.col("history"))))


def start(turns: DataFrame, sink, checkpoint: str, **options):
    """Runs the stream once over what is there; sink is a function of a batch's DataFrame and its number."""
    out = results(turns, **options)
    return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def stateless(turns: DataFrame) -> DataFrame:
    """The part of a stream that needs no state or model: cleaning, words and links of each turn."""
    return sanitized(turns).withColumn("words", T.word_count(F.col("sanitized"))).withColumn("urls", T.extract_urls(F.col("text")))
