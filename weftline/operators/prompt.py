"""Prompt payloads: messages as arrays of structs, and their JSON with keys in alphabetical order.

A text that is no valid UTF-8 is an error, since no JSON can hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as T

MESSAGE = "array<struct<content:string,role:string>>"


def messages(system: str, text: Column, context: Column | None = None, history: Column | None = None) -> Column:
    """system, then the history, then the text under its context."""
    one = lambda role, content: F.array(F.struct(F.validate_utf8(content).alias("content"), F.lit(role).alias("role"))).cast(MESSAGE)
    parts = [one("system", F.lit(system))]
    if history is not None:
        parts.append(F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.struct(F.validate_utf8(m["content"]).alias("content"), F.validate_utf8(m["role"]).alias("role"))).cast(MESSAGE))
    content = T.user_content(text, context) if context is not None else text
    return F.concat(*parts, one("user", content))


def payload(system: str, text: Column, context: Column | None = None, history: Column | None = None) -> Column:
    """The messages as a JSON array."""
    return F.to_json(messages(system, text, context, history))


def check_api(model: str | None, temperature: float | None, max_tokens: int | None) -> None:
    if model is None and (temperature is not None or max_tokens is not None):
        raise ValueError("temperature and max_tokens need a model")


def api_payload(system: str, text: Column, context: Column | None = None, history: Column | None = None, model: str | None = None, temperature: float | None = None, max_tokens: int | None = None) -> Column:
    """The request object of a chat API as JSON; options that are not given are left out.

    The temperature is a single-precision number that is printed as a double.
    """
    check_api(model, temperature, max_tokens)
    fields = []
    if max_tokens is not None:
        fields.append(F.lit(max_tokens).alias("max_tokens"))
    fields.append(messages(system, text, context, history).alias("messages"))
    if model is not None:
        fields.append(F.lit(model).alias("model"))
    if temperature is not None:
        fields.append(F.lit(temperature).cast("float").cast("double").alias("temperature"))
    return F.to_json(F.struct(*fields))
