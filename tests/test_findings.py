"""Inputs on which queries once differed from their SQL, and bounds that once grew with the input."""

import duckdb
import pytest

from quillmask.operators import detect, evaluate
from quillmask.plans import catalog

ODD = [
    "coción 89.251.154.93 las", "für 31.199.233.235 auf", "ñ12345678Z ü12345678Z", "١٢٣٤٥٦٧٨Z", "12 1234567890 12 1234567890",
    "ſara@maſ.org Kim@example.KK", "ES12ı2100 İS12 2100 0418 4502", "12\x0b1234567890 12345678\x0bZ", "é+34 600-111-222é", "áx@b.có z@b.coñ", "", "12\n1234567890 12345678\tZ",
]


def stored(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))


def same(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(folder)), con.sql(catalog.ORACLES[name])
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall())
    return rows


@pytest.mark.parametrize("name", ["regex_spans_all", "regex_spans_pages", "detected_by_type", "mask_documents"])
def test_identifiers_beside_other_letters_equal_sql(spark, tmp_path, name):
    stored(spark, tmp_path, list(enumerate(ODD)), "doc_id long, text string", "documents")
    stored(spark, tmp_path, list(enumerate(ODD)), "page_id long, html string", "pages")
    assert same(spark, tmp_path, name, ("documents", "pages"))


def test_spans_of_empty_texts_equal_sql(spark, tmp_path):
    stored(spark, tmp_path, [(0, "a text"), (1, ""), (2, None), (3, "x")], "doc_id long, text string", "documents")
    stored(spark, tmp_path, [(i,) for i in range(5)], "o_orderkey long", "orders")
    assert [r[2] for r in same(spark, tmp_path, "spans_per_char", ("documents", "orders"))] == [float("inf")] * 2
    stored(spark, tmp_path, [(0, "a text"), (2, None), (3, "x")], "doc_id long, text string", "documents")
    assert [r[2] for r in same(spark, tmp_path, "spans_per_char", ("documents", "orders"))] == [3.5] * 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sets_of_spans_are_shuffled_once_and_hold_nulls(spark):
    schema = "doc_id long, start int, stop int, entity_type string"
    p = spark.createDataFrame([(1, 0, 2, "A"), (1, 0, 2, "A"), (1, None, 2, "A"), (2, 5, 6, "B")], schema)
    g = spark.createDataFrame([(1, 0, 2, "A"), (1, None, 2, "A"), (3, 5, 6, "B")], schema)
    got = evaluate.exact_sets(p, g)
    assert exchanges(got) == 1
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 1), (2, 0, 1, 0), (3, 0, 0, 1)]
    assert exchanges(evaluate.set_sides(p, g)) == 1
    assert evaluate.set_sides(p, g).where("p and g").count() == 2


COMPONENT_TYPES = [("01-REGEX", "NAME"), ("02-SPACY", "NAME"), ("02-SPACY", "COMPANY")]
SPAN = "doc_id long, ord int, start int, stop int, entity_type string, id string"


def test_components_are_scoped_after_one_shuffle(spark):
    golds = spark.createDataFrame([(1, 0, 0, 2, "NAME", "a"), (1, 1, 3, 4, "ORG", "a"), (2, 0, 0, 2, "ADDRESS", "a"), (2, 1, 0, 2, None, "a")], SPAN)
    rows = [(1, 0, 0, 2, "PERSON", "a", "01-REGEX"), (1, 1, 3, 4, "COMPANY", "a", "02-SPACY"), (1, 2, 3, 4, "COMPANY", "a", "01-REGEX"), (3, 0, 0, 1, "NAME", "a", None), (3, 1, 0, 1, None, "a", "02-SPACY")]
    preds = spark.createDataFrame(rows, SPAN + ", component string")
    types = spark.createDataFrame(COMPONENT_TYPES, "component string, entity_type string")
    got = evaluate.paired(preds, golds, types)
    show = lambda df: sorted(map(str, df.select("scope", "doc_id", "entity_type", "p", "g").collect()))
    assert show(got) == show(evaluate.paired(*evaluate.scoped(preds, golds, types)))
    assert exchanges(got.drop("none")) <= 2  # the rows' and that of the distinct types


def test_by_id_matches_lists_of_a_slice(spark):
    s = lambda *rows: [{"ord": i, "start": a, "stop": b, "id": k} for i, (a, b, k) in enumerate(rows)]
    item = "array<struct<ord:int,start:int,stop:int,id:string>>"
    rows = [("x", i, "NAME", s((0, 4, "1"), (5, 9, None))[: i % 3], s((0, 4, "7"), (5, 9, "8"))[: i % 4]) for i in range(24)]
    frame = spark.createDataFrame(rows, f"scope string, doc_id long, entity_type string, p {item}, g {item}")
    for optimal in (False, True):
        got = {r["doc_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.counted_by_id(frame.where("doc_id > 2"), "x", 0.5, optimal).collect()}
        assert got == {i: ((n := int(i % 3 > 0 and i % 4 > 0)), i % 3 - n, min(i % 4, 2) - n) for i in range(3, 24)}


def test_chunks_come_in_bounded_batches(spark):
    docs = spark.createDataFrame([(i, "word " * 200_000) for i in range(12)], "doc_id long, text string").coalesce(1)
    sizes = detect.char_chunked(docs).mapInPandas(lambda it: (b.assign(n=b["piece"].str.len()).groupby(b["doc_id"] * 0)["n"].sum().to_frame() for b in it), "n long")
    found = [r["n"] for r in sizes.collect()]
    assert sum(found) > 12_000_000 and max(found) < 2 * 2**22


def test_letters_are_dealt(spark, tmp_path):
    stored(spark, tmp_path, [(i, f"Customer#{i}") for i in range(64)], "c_custkey long, c_name string", "customer")
    plan = catalog.QUERIES["highlight_documents"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
