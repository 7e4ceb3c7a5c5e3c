"""BPE, chat formatting and URL filters; the catalogue's queries against their SQL; the pipeline."""

import hashlib
import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from quillmask.llm import bpe, catalog, chat_format, url_filter

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(catalog.vocabulary("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    return tok


def alphabet():
    return ["it's", "we'll", " ", "  ", "\n\n", "\t", "\u00a0", "\u2028", "\u3000", "é", "ñandú", "你好", "😀", "123", "٣", "<|endoftext|>", "don't!", "...", "a", "THE", "'s", "x" * 50, "\u0301", "\x1c", "\x85", "\ufeff", "\0"]


def test_bpe_equals_the_library(spark, tokenizer):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(alphabet()) for _ in range(r.randrange(40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "ab" * 40_000), (None, "x y"), (5, rows[5][1])]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, ids int, n_tokens int")
    docs = docs.unionByName(catalog.table(spark, TINY, "documents").select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("n_tokens")))
    path = catalog.vocabulary("byte_bpe_50k.json")
    got = sorted(tuple(x) for x in bpe.encode_digests(docs.where("doc_id is not null"), path).collect())
    want = []
    for d, t in docs.where("doc_id is not null").select("doc_id", "text").collect():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    full = {r["doc_id"]: r for r in bpe.encode_documents(docs, path).collect()}
    assert full[None]["decoded"] == "x y" and full[1000]["ids"] == []
    assert bpe.encode_digests(docs.limit(0), path).count() == 0


def test_chat_round_trip(spark):
    hard = ["\\", "\\b", "###", "####", "</turn>", "<</turn>/turn>", "### Assistant: x</turn>\n### User: ", "", None, "a\nb", "\\h\\t", "😀" * 3, "#" * 7, "y" * 100_000]
    r = random.Random(5)
    roles = ["user", "assistant", "system", "tool: x", "###", "~", "", None]
    rows = [(c, t, r.choice(roles), r.choice(hard)) for c in (*range(40), None) for t in range(r.randrange(1, 9))]
    rows += [(7, None, "user", "first"), (8, 0, "assistant", "same"), (8, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, n int, formatted int")
    chats = chat_format.format_chats(turns)
    got = {x["conv_id"]: x for x in chat_format.parse_chats(chats).collect()}
    order = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in (x[1], x[2])) + ((x[3] or ""),)
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=order)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(x[2], x[3] or "") for x in own]
        assert got[c]["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert chat_format.digests(chat_format.format_chats(turns.limit(0))).count() == 0


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x", "http://example.com/en/", "https://a.example.com/de", "x.net/es/", "http://x.net/es/a?b#c", "http://net", "http://", "", None, "http://xexample.com/en/", "a://b://c.net/fr/", "http://example.com?x=/en/", "http://" + "a." * 5000 + "com/" + "p" * 100_000]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in [*enumerate(urls), (0, urls[0]), (None, "http://q.net/es/")]], "page_id long, url string, host string, path string")
    rules = catalog.values(spark, "host, path, verdict", list(catalog.URL_RULES))
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == len(urls) + 2
    said = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert said[0] == ("www.example.com/en/", "allow") and said[1] == ("example.com/en/", "block") and said[2] == ("com/", "allow")
    assert said[3] == (None, "allow") and said[4] == ("net/es/", "block") and said[5] == said[6] == said[7] == said[8] == (None, "allow")
    assert said[9] == ("com/", "allow") and said[11] == (None, "allow") and said[12] == ("com/", "allow") and said[None] == ("net/es/", "block")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(str(r) for r in want.fetchall())


def test_pipeline_stages(spark):
    docs = catalog.table(spark, TINY, "documents")
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        out = stage(spark, docs, TINY).cache()
        if n < len(corpus_pipeline.STAGES):
            assert out.columns == columns and 0 < out.count() <= docs.count()
            docs = out
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert sum(r["length"] for r in out.collect()) == sum(r["doc_tokens"] for r in out.dropDuplicates(["doc_id"]).collect())


def test_pipeline_odd_rows(spark):
    docs = catalog.table(spark, TINY, "documents")
    long = " ".join(f"w{i}x" for i in range(60_000))
    rows = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, "en", "s", None), (-3, long, "en", "s", 1), (-3, long, "en", "s", 1)], docs.schema)
    for base in (docs.limit(0), docs.limit(20)):
        kept = base.unionByName(rows)
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, TINY)
        assert kept.where("doc_id = -3").agg(F.sum("length")).first()[0] is not None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), TINY).count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, TINY).count() > 0
