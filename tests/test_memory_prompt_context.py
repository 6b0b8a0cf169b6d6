import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import context, memory, prompt

SCHEMA = "conv_id long, id long, role string, content string, ts timestamp"


def log(spark, n, conv=1):
    return spark.createDataFrame([(conv, i, "user" if i % 2 else "assistant", f"m{i}'; --", None) for i in range(1, n + 1)], SCHEMA)


def test_recent(spark):
    df = log(spark, 4)
    show = lambda d: [m["content"][:2] for r in d.collect() for m in r["history"]]
    assert show(memory.recent(df, 2)) == ["m3", "m4"]
    assert show(memory.recent(df, 99)) == show(memory.recent(df, -1)) == ["m1", "m2", "m3", "m4"]
    assert show(memory.recent(df, 0)) == []
    assert [r["id"] for r in memory.latest_of_log(df, 3).collect()] == [2, 3, 4]


def test_append_prune_update_clear(spark):
    df = log(spark, 3)
    new = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y"), (2, 0, "user", "z")], "conv_id long, ord int, role string, content string")
    assert {(r["conv_id"], r["id"], r["content"]) for r in memory.append(df, new).filter("id > 3 OR conv_id = 2").collect()} == {(1, 4, "x"), (1, 5, "y"), (2, 1, "z")}
    assert sorted(r["id"] for r in memory.prune(df, 2).collect()) == [2, 3]
    with pytest.raises(ValueError):
        memory.prune(df, 0)
    assert [r["content"] for r in memory.update_last(df, F.lit("new")).orderBy("id").collect()][-1] == "new"
    empty, water = memory.clear(df)
    assert empty.count() == 0
    with pytest.raises(RuntimeError):
        memory.update_last(empty, F.lit("new"))
    assert [r["id"] for r in memory.append(empty, new.filter("conv_id = 1"), water).orderBy("id").collect()] == [4, 5]


def test_table_is_made_once(spark):
    memory.create_table(spark, "message_log")
    memory.create_table(spark, "message_log")
    assert spark.table("message_log").count() == 0
    spark.sql("DROP TABLE message_log")


def made(spark, column):
    df = spark.createDataFrame([("q", "ctx", [("user", "a"), ("assistant", "b")])], "s string, c string, h array<struct<role:string,content:string>>")
    return json.loads(df.select(column).first()[0])


def test_payloads(spark):
    s, c, h = F.col("s"), F.col("c"), F.col("h")
    plain = made(spark, prompt.payload("sys", s))
    assert plain == [{"content": "sys", "role": "system"}, {"content": "q", "role": "user"}]
    full = made(spark, prompt.payload("sys", s, c, h))
    assert [m["role"] for m in full] == ["system", "user", "assistant", "user"] and "<context>ctx</context>" in full[-1]["content"]
    api = made(spark, prompt.api_payload("sys", s, None, h, "m", 0.7, 5))
    assert list(api) == ["max_tokens", "messages", "model", "temperature"] and api["temperature"] == 0.699999988079071
    assert list(made(spark, prompt.api_payload("sys", s))) == ["messages"]
    for bad in ({"temperature": 0.1}, {"max_tokens": 3}):
        with pytest.raises(ValueError):
            prompt.api_payload("sys", s, **bad)


@pytest.mark.parametrize("where", ["s", "c", "h"])
def test_text_that_is_no_utf8_is_an_error(spark, where):
    bad = spark.range(1).select(*[F.expr("cast(X'61ff' as string)" if k == where else "'ok'").alias(k) for k in "sch"])
    df = bad.withColumn("h", F.array(F.struct(F.lit("user").alias("role"), F.col("h").alias("content"))))
    with pytest.raises(Exception, match="UTF8"):
        df.select(prompt.payload("sys", F.col("s"), F.col("c"), F.col("h"))).collect()


def test_fetch_and_context(spark):
    def fetcher(url):
        if "bad" in url:
            raise RuntimeError("HTTP 404")
        return f"<{url[-1]}>"

    turns = spark.createDataFrame([(1, "see http://a.example/1, http://bad.example/2 and http://a.example/3 http://a.example/1"), (2, "none"), (3, None)], "i int, text string")
    from weftline.functions import text as T

    urls = turns.select(F.explode(T.extract_urls(F.col("text"))).alias("url"))
    bodies = context.fetch(urls, fetcher)
    assert bodies.count() == 3 and bodies.filter("error IS NOT NULL").count() == 1
    got = {r["i"]: r["context"] for r in context.url_context(turns, bodies, "i", "text").collect()}
    assert got == {1: "<1><3><1>", 2: "", 3: ""}
    with pytest.raises(ValueError):
        context.fetch_url("ftp://a.example/x")


def test_size_limit(spark):
    sizes = [context.MOST_BYTES, context.MOST_BYTES + 1]
    df = spark.createDataFrame([(n,) for n in sizes], "n int").withColumn("body", F.repeat(F.lit("x"), F.col("n")))
    assert [r[0] for r in df.orderBy("n").select(context.small_enough("body")).collect()] == [True, False]
