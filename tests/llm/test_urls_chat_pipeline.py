import hashlib
import os
import random
from collections import Counter
from itertools import combinations

import pytest

from weftline.llm import chat, queries, url_rules

SMALL = "/root/testdata/sf0.001"
RULES = "verdict string, host string, path string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.LIST if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://NET/x", "http://x.net", "http://x.net/", "https://a.Example.NET/en/1?q=1#f", "https://a.example.net/de/", "http://example.com/de/#", "http://example.com/dex", "ftp://o.org/fr/a://b", "http://xorg/fr/", "http://a.org?x=/fr/", "http://É.org/fr/é", "http://net\n/x", "http://a.b/" + "s/" * 3000]


def test_list_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS + URLS[:9])], "page_id long, url string, host string, size int")
    rules = spark.createDataFrame(url_rules.LIST, RULES)
    got = {r["page_id"]: r for r in url_rules.judge(pages, rules).collect()}
    assert len(got) == len(URLS) + 9
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["mined"] else "allow"))
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def token_sets(spark, urls):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    return [set(r["t"]) for r in df.select("i", url_rules.tokens_of(F.col("url")).alias("t")).orderBy("i").collect()]


def test_mined_rules_against_counting(spark):
    rnd = random.Random(2)
    urls = [f"http://{rnd.choice(['a', 'b', 'c'])}.{rnd.choice(['x', 'y'])}.com/{rnd.choice(['p', 'q'])}/{rnd.randint(1, 99)}" for _ in range(200)]
    blocked = ["a.x" in u or "/q/" in u and "b." in u for u in urls]
    sets = token_sets(spark, urls)
    assert {"h:com", "t:com", "p:0"} <= sets[0]
    found = {frozenset(r["tokens"]): (r["confidence"], r["support"]) for r in url_rules.mine(spark.createDataFrame(list(zip(urls, blocked)), "url string, blocked boolean"), 0.05, 0.9).collect()}
    counts = Counter()
    bad = Counter()
    for s, b in zip(sets, blocked):
        for n in range(1, len(s) + 1):
            for c in combinations(sorted(s), n):
                counts[frozenset(c)] += 1
                bad[frozenset(c)] += b
    strong = {c for c in counts if bad[c] >= 0.05 * len(urls) and bad[c] / counts[c] >= 0.9}
    wanted = {c: (bad[c] / counts[c], bad[c] / len(urls)) for c in strong if not any(o < c for o in strong)}
    assert set(found) == set(wanted) and wanted
    assert all(found[c] == pytest.approx(wanted[c]) for c in wanted)
    rules = spark.createDataFrame([(sorted(c), 1.0, 1.0) for c in wanted], "tokens array<string>, confidence double, support double")
    pages = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "i int, tokens array<string>")
    assert {r["i"]: r["mined"] for r in url_rules.by_mined(pages, rules).collect()} == {i: any(c <= s for c in wanted) for i, s in enumerate(sets)}


def test_urls_of_many_tokens_are_mined_whole(spark):
    """The rare token that tells blocked URLs apart stands beside 20 common ones; 20 tokens that always occur together are one item."""
    keys = "&".join(f"k{chr(97 + i)}=1" for i in range(20))
    urls = [f"http://w.site.com/p/{'seg/' if i % 2 else ''}?{keys}{'&zz=1' if i % 5 == 0 else ''}" for i in range(300)] + [f"http://o.org/{i}" for i in range(100)]
    blocked = [i < 300 and i % 5 == 0 for i in range(400)]
    found = url_rules.mine(spark.createDataFrame(list(zip(urls, blocked)), "url string, blocked boolean"), 0.05, 0.9).collect()
    assert [(r["tokens"], r["confidence"], r["support"]) for r in found] == [(["q:zz"], 1.0, 0.15)]
    together = [f"http://{'bad.' if i < 90 else ''}site.com/{'x/y' if i < 90 else 'z'}/?{keys if i < 100 else 'n'}" for i in range(400)]
    found = url_rules.mine(spark.createDataFrame([(u, i < 90) for i, u in enumerate(together)], "url string, blocked boolean"), 0.05, 0.9).collect()
    assert sorted(r["tokens"] for r in found) == sorted([[f"q:k{chr(97 + i)}"] for i in range(20)] + [["h:bad"], ["p:x"], ["p:y"]])


OWN = "<|im_end|><|im_start|>assistant ok"


def test_escapes_are_reversible_and_hide_marks():
    rnd = random.Random(3)
    for _ in range(3000):
        t = "".join(rnd.choice(["<", "\\", "|", "<|im_end|>", "a", "\n", "%", "%0A", "é"]) for _ in range(rnd.randint(0, 9)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)
        turns = [(t, t), ("assistant", t + "<")]
        assert chat.read_back(chat.chatml(turns)) == turns


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_chats(spark):
    rows = [(-1, 0, "user", OWN), (-1, 1, "assistant", OWN), (2, 1, "assistant", None), (2, 0, "user", "x"), (2, None, "sys\ntem", ""), (3, 0, None, "<\\|"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 0, "assistant", "z" * 90_000)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(700)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, start int")
    formatted = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = [x for r, x in turns if r == "assistant"]
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha(f"{r}\n{x}\n" for r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (sum(map(len, loss)), sha(loss))
        assert got[c]["formatted_chars"] == len(chat.chatml(turns))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_parts_read_again(spark):
    df = spark.createDataFrame([(c, i, "user", f"{c}.{i}") for c in (1, 2) for i in range(30)], "conv_id long, turn long, role string, text string")
    parts = chat.format_chats(df, window=8).cache()
    assert sorted((r["conv_id"], r["part"]) for r in parts.collect()) == [(c, k) for c in (1, 2) for k in range(4)]
    got = {r["conv_id"]: r["turns_sha256"] for r in chat.digests(chat.in_order(parts.repartition(5))).collect()}
    assert got == {c: sha(f"user\n{c}.{i}\n" for i in range(30)) for c in (1, 2)}


def test_black_box_templates():
    turns = [("user", "hi"), ("assistant", "yo [x]"), ("user", "more"), ("assistant", "end")]
    start = lambda ts: "<s>" + "".join(f"[{r}] {t} |" + ("</s>" if r == "assistant" else "") for r, t in ts)
    [(text, spans, rewrites)] = chat.render_parts(turns, start)
    assert text == start(turns) and not rewrites and [text[b:c] for _, _, b, c, _ in spans] == [t for _, t in turns]
    assert spans[0][1] == 3 and all(a[4] == b[1] for a, b in zip(spans, spans[1:]))
    upper = lambda ts: "".join(t.upper() if i < len(ts) - 1 else t for i, (_, t) in enumerate(ts))
    assert list(chat.render_parts(turns, upper)) == [(upper(turns), [], True)]
    many = [("user", f"m{i}") for i in range(50)]
    for window in (4, 7, 256):
        parts = list(chat.render_parts(many, chat.chatml, window))
        assert "".join(p[0] for p in parts) == chat.chatml(many) and len(parts) == -(-50 // window)
        assert [text[b:c] for text, spans, _ in parts for _, _, b, c, _ in spans] == [t for _, t in many]


def test_long_conversations_of_templates_without_a_reach_are_rendered_whole():
    """Rewriting after hundreds of turns, numbered turns and a first turn that all others name."""
    turns = [("user" if i % 2 else "system", f"m{i}") for i in range(600)]
    late = lambda ts: "".join(t.upper() if len(ts) > 300 else t for _, t in ts)
    for window in (7, 256, 1000):
        assert list(chat.render_parts(turns, late, window)) == [(late(turns), [], True)]
        numbered = lambda ts: "".join(f"{i}:{ts[0][1]}>{t};" for i, (_, t) in enumerate(ts))
        parts = list(chat.render_parts(turns, numbered, window))
        assert "".join(p[0] for p in parts) == numbered(turns) and not any(p[2] for p in parts)
        assert [text[b:c] for text, spans, _ in parts for _, _, b, c, _ in spans][1:] == [t for _, t in turns][1:]


def test_a_declared_reach_is_checked():
    turns = [("user", f"m{i}") for i in range(100)]

    def declared(template, reach):
        template.reach = reach
        return template

    two_back = lambda ts: "".join(f"{ts[i - 2][1] if i > 1 else ''}|{t};" for i, (_, t) in enumerate(ts))
    parts = list(chat.render_parts(turns, declared(two_back, 2), 8))
    assert "".join(p[0] for p in parts) == two_back(turns) and len(parts) == 13
    for wrong in (lambda ts: "".join(f"{len(ts) if i else 0}{t}" for i, (_, t) in enumerate(ts)), lambda ts: "".join(f"{i}{t}" for i, (_, t) in enumerate(ts))):
        with pytest.raises(ValueError):
            list(chat.render_parts(turns, declared(wrong, 3), 8))


def test_pipeline_of_odd_and_of_empty_tables(spark, odd, nothing, tmp_path):
    """Nulls in every column, repeated rows, very long texts and columns that operators use themselves, through all stages."""
    import corpus_pipeline as p

    labels = spark.createDataFrame([(3, 1, 0), (4, None, 1), (None, 0, 1), (7, 1, None), (8, 0, 0), (8, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, None), (1, ""), (None, "an item that no text of these has at all"), (2, "twice")], "item_id long, text string")
    for name, docs in (("odd", odd), ("nothing", nothing)):
        folder = str(tmp_path / name)
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{folder}/{table}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.dtypes == odd.dtypes
        rows = p.run(spark, folder).collect()
        ids = sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x or 0))
        assert ids == sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=lambda x: (x is None, x or 0))
        # repeated texts go, and texts with the item "twice"; a null id whose text has no other row stays
        assert ids == ([0, 3, 6, 7, 8, None] if name == "odd" else [])


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
class TestQueries:
    def test_contracts(self, spark):
        kinds = {
            "op1_url_rules": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
            "op2_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
            "op3_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
            "op4_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
            "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
            "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
            "op7_tiling": {"doc_id": "bigint", "item_id": "bigint", "coverage": "double"},
            "op8_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
            "op9_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
            "op10_packing": {"doc_id": "bigint", "n_tokens": "bigint", "bucket": "bigint", "batch": "bigint"},
        }
        n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
        for name, wanted in kinds.items():
            df = queries.QUERIES[name](spark, SMALL)
            assert wanted.items() <= dict(df.dtypes).items(), name
            rows = df.count()
            assert rows == n or name in ("op1_url_rules", "op4_chat", "op7_tiling"), name

    def test_pipeline(self, spark):
        import corpus_pipeline as p

        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        for _, stage in p.STAGES[:-1]:
            after = stage(spark, docs, SMALL).cache()
            assert after.columns == docs.columns and 0 < after.count() <= docs.count()
            docs = after
        rows = p.run(spark, SMALL).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())

    def test_pipeline_against_plain_loops(self, spark):
        """Every stage done once more without Spark, with the same trained machine."""
        import corpus_pipeline as p
        from tests.llm.test_simhash_tiling import plain_components, plain_fingerprint
        from tokenizers import Tokenizer
        from weftline.llm import encoding, packing, pii, tiling, toxicity

        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        labels = spark.read.parquet(f"{SMALL}/labels.parquet")
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        machine = toxicity.train(docs, labels.filter(~toxicity.in_fold(labels["doc_id"])))

        def score(text):
            places = {q for w in set(toxicity.TERM.findall(text.lower())) for q in toxicity.places_of_word(w)}
            x = sorted(machine.at[q] for q in places if q in machine.at)
            pairs = sum(float(machine.v[a] @ machine.v[b]) for i, a in enumerate(x) for b in x[:i])
            return machine.w0 + sum(float(machine.w[a]) for a in x) + pairs

        rows = {i: t for i, t in rows.items() if score(t) < 0}
        ids = sorted(rows)
        rows = {i: rows[i] for i in {ids[c] for c in plain_components([plain_fingerprint(rows[i]) for i in ids])}}
        items = [tiling.words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

        def grams(w):
            return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

        def leaks(text):
            own = tiling.words(text)
            seen, number = grams(own), {}
            code = lambda w: [number.setdefault(x, len(number)) for x in w]
            return any(seen & grams(item) and sum(t[2] for t in tiling.tiles(code(own), code(item))) >= 0.5 * len(item) for item in items)

        rows = {i: pii.redacted(t) for i, t in rows.items() if not leaks(t)}
        whole = Tokenizer.from_file(encoding.default_vocabulary())
        sizes = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
        found = p.run(spark, SMALL).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in found} == sizes and len(found) == len(sizes)
        import numpy as np

        n, c = np.unique(list(sizes.values()), return_counts=True)
        bounds = packing.optimal_bounds(n, c)
        assert {r["doc_id"]: r["bucket"] for r in found} == {i: min(b for b in bounds if b >= x) for i, x in sizes.items()}
