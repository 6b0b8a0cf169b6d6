"""File sources: vocabularies, message tables, result documents of benchmark runs."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any of Spark's file systems; none if it is not there."""
    at, files = _at(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """token and token_id of a vocabulary file: the id is the line's number, empty lines count but are no token, and
    the last of equal lines wins. The file is read whole, so that lines keep their numbers."""
    if "://" not in path and not os.path.exists(path):
        raise RuntimeError(f"the vocabulary can't be read: {path}")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("token_id", "token"))
    return lines.filter("token <> ''").groupBy("token").agg(F.max("token_id").cast("long").alias("token_id"))


def _encoding(path: str) -> str | None:
    with open(path, "rb") as f:
        start = f.read(2)
    return "UTF-16" if start in (b"\xff\xfe", b"\xfe\xff") else None


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """The one-row table of a benchmark document (UTF-8 or UTF-16 by its byte order mark)."""
    encoding = _encoding(path)  # the reader sees a UTF-8 mark itself, if no encoding is named
    reader = spark.read.option("multiLine", True)
    return (reader.option("encoding", encoding) if encoding else reader).json(path)


def sections(document: DataFrame) -> dict[str, DataFrame]:
    """The document's arrays as tables, by name."""
    kinds = dict(document.dtypes)
    return {c: document.select(F.explode(c).alias("x")).select("x.*") for c, kind in kinds.items() if kind.startswith("array<struct")}


def write_results(parts: dict[str, DataFrame], path: str) -> None:
    """Each table as a folder of JSON lines below path."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def document(parts: dict[str, DataFrame | dict | float | int | str]) -> dict:
    """One document of tables (as arrays of objects, bounded as reports are) and plain values."""
    rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    return {k: rows(x) if isinstance(x, DataFrame) else x for k, x in parts.items()}


def write_document(parts: dict, path: str) -> None:
    """The document as one JSON file, with two spaces for each level."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document(parts), f, indent=2, ensure_ascii=False)
        f.write("\n")
