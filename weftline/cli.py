"""Command line: answers the lines of standard input, or of a file, one after the other and prints actions and payloads.

The log is kept at the configuration's db_path, so that the next run goes on from it.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators.embed import HashingProvider, OnnxProvider
from .operators.route import Registry
from .operators.tokenize import cutter_of
from .plans.live import Live, lines_of
from .sources.config import intents, load_config

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    parser.add_argument("-v", "--version", action="version", version=VERSION)
    parser.add_argument("config", nargs="?", default="config.json")
    parser.add_argument("--input", default="-", help="file of turns; standard input by default")
    parser.add_argument("--hashing", action="store_true", help="route with hashed word counts instead of a model")
    given = parser.parse_args(argv)
    try:
        config = load_config(given.config)
        lines = sys.stdin if given.input == "-" else open(given.input, encoding="utf-8", newline="\n")
        spark = SparkSession.builder.appName("weftline").getOrCreate()
        provider = HashingProvider() if given.hashing else None
        if provider is None and os.path.exists(config.model_path) and os.path.exists(config.vocab_path):
            with open(config.vocab_path, encoding="utf-8") as f:
                vocabulary = {t: i for i, t in enumerate(f.read().split("\n")) if t}
            provider = OnnxProvider(config.model_path, cutter_of(vocabulary).ids)
        registry = Registry.of(intents(spark, config), provider) if provider and config.intents else Registry()
        for name in sorted({name for name, _ in registry.rows}):
            print(f"Registered intent: {name}")
        if provider is None:
            print("[INFO] Model files not found: routing is off.")
        for stream, text in lines_of(Live(spark, config, registry, provider), lines):
            print(text, file=sys.stderr if stream == "err" else sys.stdout, flush=True)
    except (OSError, RuntimeError, ValueError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
