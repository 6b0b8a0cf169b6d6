"""URL context: the pages that a text links to, fetched or looked up, put together in the order of the links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

MOST_BYTES = 10 * 1024 * 1024
TIMEOUT_S, AGENT = 15, "weftline/1.0"


def fetch_url(url: str) -> str:
    """Body of an http or https URL after redirects; an error for any other answer than 200, or for too many bytes."""
    import urllib.request

    if not url.startswith(("http://", "https://")):
        raise ValueError("only http and https are read")
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
        if answer.status != 200:
            raise RuntimeError(f"HTTP {answer.status}")
        if int(answer.headers.get("Content-Length") or 0) > MOST_BYTES:
            raise RuntimeError("the body is too large")
        body = answer.read(MOST_BYTES + 1)
    if len(body) > MOST_BYTES:
        raise RuntimeError("the body is too large")
    return body.decode("utf-8", "replace")


def fetch(urls: DataFrame, fetcher: Callable[[str], str] = fetch_url) -> DataFrame:
    """url, body and error of each distinct url; a failure leaves body null."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append((url, fetcher(url), None))
                except Exception as e:  # noqa: BLE001  the row carries the failure
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "body", "error"])

    return urls.select("url").distinct().mapInPandas(get, "url string, body string, error string")


def fetched_context(df: DataFrame, text_col: str, wanted=None, fetcher: Callable[[str], str] = fetch_url) -> DataFrame:
    """df with `context`: the bodies of the text's URLs, read one after the other, and `failed`, the URLs that gave an error.

    Only rows for which `wanted` is true fetch anything. Nothing is shuffled, so this also runs on streams; a URL that stands
    in several rows of an Arrow batch is read once.
    """
    urls = T.extract_urls(F.col(text_col))
    urls = urls if wanted is None else F.when(wanted, urls)

    def get(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in batches:
            bodies: dict[str, str | None] = {}
            out = []
            for of in lists:
                of = [] if of is None else list(of)
                for url in of:
                    if url not in bodies:
                        try:
                            bodies[url] = fetcher(url)
                        except Exception:  # noqa: BLE001  a link that can't be read is left out
                            bodies[url] = None
                out.append(("".join(bodies[u] or "" for u in of), [u for u in of if bodies[u] is None]))
            yield pd.DataFrame(out, columns=["context", "failed"])

    # As in route_rows, a generator of one row keeps lambda functions out of the Python function's arguments.
    listed = df.select("*", F.explode(F.array(urls)).alias("__urls"))
    read = listed.withColumn("__read", F.pandas_udf(get, "context string, failed array<string>")("__urls"))
    return read.withColumn("context", F.col("__read.context")).withColumn("failed", F.col("__read.failed")).drop("__urls", "__read")


def small_enough(body):
    return F.octet_length(body) <= MOST_BYTES


def url_context(df: DataFrame, bodies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with `context`: the bodies of the text's URLs in order, without separator; '' where there are none.

    bodies has url and body; missing, null and too large ones are left out. id_col must be unique.
    """
    links = df.select(F.col(id_col).alias("__id"), F.posexplode(T.extract_urls(F.col(text_col))).alias("pos", "url"))
    read = bodies.select("url", "body").filter(F.col("body").isNotNull() & small_enough("body"))
    found = links.join(read, "url").groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "").alias("context"))
    return df.join(found, F.col(id_col) == F.col("__id"), "left").drop("__id").withColumn("context", F.coalesce("context", F.lit("")))
