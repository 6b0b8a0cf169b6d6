"""The JSON configuration: defaults, checks and the intent registry it describes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

EXAMPLES = "reg_ord int, intent_ord int, name string, example_ord int, example string"


@dataclass(frozen=True)
class Config:
    model_path: str = "models/model.onnx"
    vocab_path: str = "models/vocab.txt"
    db_path: str = "history.db"
    system_prompt: str = "You are a helpful AI assistant."
    similarity_threshold: float = 0.65
    history_limit: int = 10
    api_model: str | None = None
    api_endpoint: str | None = None
    api_temperature: float | None = None
    api_max_tokens: int | None = None
    intents: list[tuple[str, list[str]]] = field(default_factory=list)


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _typed(raw: dict, key: str, default, fits):
    value = raw.get(key, default)
    if not fits(value):
        raise TypeError(f"{key} has the wrong type")
    return value


def _intent(entry: dict) -> tuple[str, list[str]]:
    """A name with its examples; the list `examples` goes before the single `example`."""
    if not isinstance(entry, dict) or "name" not in entry:
        raise ValueError("an intent needs a name")
    many, one = entry.get("examples"), entry.get("example")
    if isinstance(many, list):
        found = many
    elif one is not None:
        found = [one]
    else:
        raise ValueError(f"intent {entry['name']} needs an example")
    if any(not isinstance(x, str) for x in found):
        raise TypeError("an example must be a string")
    if not found:
        raise ValueError(f"intent {entry['name']} has no examples")
    return entry["name"], found


def parse_config(text: str) -> Config:
    """Configuration from JSON text. Unknown keys and API options of another type are passed over."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise RuntimeError(f"the configuration is not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise RuntimeError("the configuration is not a JSON object")
    base = Config()
    is_text = lambda x: isinstance(x, str)
    made = {k: _typed(raw, k, getattr(base, k), is_text) for k in ("model_path", "vocab_path", "db_path", "system_prompt")}
    for key in ("model_path", "vocab_path", "db_path"):
        if not made[key]:
            raise ValueError(f"{key} is empty")
    made["similarity_threshold"] = float(_typed(raw, "similarity_threshold", base.similarity_threshold, _number))
    if not 0 <= made["similarity_threshold"] <= 1:
        raise ValueError("similarity_threshold must lie between 0 and 1")
    made["history_limit"] = int(_typed(raw, "history_limit", base.history_limit, _number))
    if made["history_limit"] < 1:
        raise ValueError("history_limit must be 1 or more")
    made |= {k: raw[k] for k in ("api_model", "api_endpoint") if is_text(raw.get(k))}
    if _number(raw.get("api_temperature")):
        if not 0 <= raw["api_temperature"] <= 2:
            raise ValueError("api_temperature must lie between 0 and 2")
        made["api_temperature"] = float(raw["api_temperature"])
    if _whole(raw.get("api_max_tokens")):
        if raw["api_max_tokens"] < 1:
            raise ValueError("api_max_tokens must be 1 or more")
        made["api_max_tokens"] = raw["api_max_tokens"]
    if isinstance(raw.get("intents"), list):
        made["intents"] = [_intent(x) for x in raw["intents"]]
    return Config(**made)


def load_config(path: str) -> Config:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise RuntimeError(f"the configuration can't be read: {path}") from e
    return parse_config(text)


def intents(spark: SparkSession, config: Config) -> DataFrame:
    """The registry's examples in their order."""
    flat = [(i, name, k, x) for i, (name, examples) in enumerate(config.intents) for k, x in enumerate(examples)]
    return spark.createDataFrame([(n, *row) for n, row in enumerate(flat)], EXAMPLES)
