"""The registered queries over all rows of a table, against brute force or their SQL."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.test_pii_quality import plain
from tests.llm.test_simhash_tiling import plain_components, plain_coverage, plain_fingerprint
from tests.llm.test_urls_chat_pipeline import plain_parts, plain_rule
from weftline.llm import encoding, packing, queries, tiling

TABLES = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def token_ids(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encoding.default_vocabulary())
    return {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    got = queries.QUERIES[name](spark, TABLES).toPandas()
    wanted = con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(wanted) and len(got) > 50


def test_urls(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    found = queries.op1_url_rules(spark, TABLES).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path = plain_parts(urls[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or ("block" if r["mined"] else "allow"))


def test_token_store(spark, token_ids):
    start, wanted = 0, []
    for i in sorted(token_ids):
        wanted.append((i, start, len(token_ids[i]), zlib.crc32(np.array(token_ids[i], "<u4").tobytes())))
        start += len(token_ids[i])
    assert sorted(tuple(r) for r in queries.op3_token_store(spark, TABLES).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == wanted


def test_simhash(spark, texts):
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    wanted = sorted((i, f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, plain_components(prints)))
    assert sorted(tuple(r) for r in queries.op5_simhash(spark, TABLES).select("doc_id", "fingerprint", "component_id").collect()) == wanted


def test_tiling(spark, texts):
    """Every text against every item; only pairs without five words of an item in a row are left out, which can't have a tile."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    of, wanted = {i: grams(tiling.words(t)) for i, t in items}, []
    assert min(len(tiling.words(t)) for _, t in items) >= 5
    for d, text in texts.items():
        own = grams(tiling.words(text))
        for i, t in items:
            if own & of[i]:
                # words beyond those that the item has can be in no tile
                known, words = set(tiling.words(t)), tiling.words(text)
                near = [k for k, w in enumerate(words) if w in known]
                keep = {j for k in near for j in range(k - 1, k + 2)}
                short = " ".join(w if w in known else "¤" for k, w in enumerate(words) if k in keep).replace("¤", "zzzz")
                n, size = plain_coverage(short, t), len(tiling.words(t))
                if n and n >= 0.5 * size:
                    wanted.append((d, i, n, size))
    assert sorted(tuple(r)[:4] for r in queries.op7_tiling(spark, TABLES).collect()) == sorted(wanted) and len(wanted) > 10


def test_base_spans(spark, texts):
    for r in queries.op8_pii(spark, TABLES).collect():
        spans = plain(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[2] == k for x in spans) for k in ("email", "ip", "card", "phone")]
        joined = [f"{k}:{s}:{e}" for s, e, k in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert not Counter(joined) - Counter(r["spans"].split(","))


def test_packing(spark, token_ids):
    """Least padding by a programme that tries every split, and batches dealt in order of length and id."""
    sizes = {i: len(x) for i, x in token_ids.items()}
    n, c = np.unique(list(sizes.values()), return_counts=True)
    rows = np.concatenate([[0], np.cumsum(c)])
    best = n * rows[1:]
    for _ in range(1, packing.BUCKETS):
        tries = best[None, :] + n[:, None] * (rows[1:, None] - rows[None, 1:])
        best = np.minimum(best, np.where(np.tri(len(n), k=-1, dtype=bool), tries, np.iinfo("i8").max).min(axis=1))
    found = queries.op10_packing(spark, TABLES).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == sizes and len(found) == len(sizes)
    assert sum(r["padding"] for r in found) == best[-1] - sum(sizes.values())
    for bucket in {r["bucket"] for r in found}:
        own = sorted((r["n_tokens"], r["doc_id"], r["batch"], r["slot"]) for r in found if r["bucket"] == bucket)
        size = max(1, packing.TOKEN_BUDGET // bucket)
        assert [x[2:] for x in own] == [(k // size, k % size) for k in range(len(own))]
