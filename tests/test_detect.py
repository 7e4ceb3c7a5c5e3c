"""Patterns, checksums and detectors against hand-made cases and Python's own regular expressions."""

import re

import pytest
from pyspark.sql import functions as F

from quillmask.functions import checksums, kinds, patterns, responses
from quillmask.operators import detect, diff


def test_offsets_equal_a_plain_scan(spark):
    texts = ["12345678Z and X1234567L", "ñ12345678Z", "😀 a@b.com 10.0.0.1", "999.1.1.1.1", "999.1.1.1", "", "٠١٢٣٤٥٦٧٨٩٠١", "fe80::1 ES12 1234 1234 1234 1234", "+34 612 345 678, 612345678\n612 34 56 78"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["entity_type"], r["start"], r["replacement"]) for r in detect.by_pattern(docs).collect()}
    want = {(i, p.name, m.start(), m[0]) for i, t in enumerate(texts) for p in patterns.PATTERNS for m in re.finditer(p.regex, t, re.I | re.M)}
    assert got == want
    assert (2, "EMAIL", 2, "a@b.com") in got and (3, "IPV4", 4, "1.1.1.1") in got and not any(i == 1 for i, *_ in got)


@pytest.mark.parametrize(("kind", "text", "good"), [("DNI", "12345678Z", True), ("DNI", " 12345678-z ", True), ("DNI", "12345678A", False), ("DNI", "12.345.678-Z", False), ("NIE", "X1234567L", True), ("NIE", "X1234567A", False), ("CIF", "A58818501", True), ("CIF", "A58818502", False), ("CIF", "A5881850", False), ("EMAIL", "a@b.com", False)])
def test_checksums(spark, kind, text, good):
    row = spark.range(1).select(checksums.valid(F.lit(kind), F.lit(text)).alias("v"), checksums.extracted(F.lit(kind), F.lit(text)).alias("x")).first()
    assert row["v"] is good
    assert (row["x"] is not None) is good


def test_wrong_control_halves_confidence(spark):
    docs = spark.createDataFrame([(1, "12345678Z 12345678A 12.345.678-Z")], "doc_id long, text string")
    got = [r["confidence"] for r in detect.by_pattern(docs, names=("DNI",)).orderBy("start").collect()]
    assert got == [0.95, 0.475, 0.475]


def test_aliases():
    assert kinds.ALIASES["PERSON"] == "NAME" and kinds.ALIASES["LOC"] == "ADDRESS"
    with pytest.raises(ValueError):
        kinds.merged_aliases({"A": (("X",), {"Y": "Z"})})
    with pytest.raises(ValueError):
        kinds.merged_aliases({"A": (("X", "W"), {"Y": "X"}), "B": (("X", "W"), {"Y": "W"})})


def test_diff_of_masked_text():
    assert diff.spans_of("Ana met Bob in Rome.", "[NAME1] met [PERSON02] in [CITY].") == [(0, 3, "NAME", "1", 1.0), (8, 11, "NAME", "2", 1.0), (15, 19, "ADDRESS", None, 1.0)]
    assert diff.spans_of("Ana  met\nBob", "[name] met [NAME0]") == [(0, 3, "NAME", None, 1.0), (9, 12, "NAME", "0", 1.0)]
    assert diff.spans_of("plain", "plain") == [] and diff.spans_of("", "[NAME]") == []


def test_service_retries_and_chunks(spark):
    text = "Ana lives in Rome. " * 40

    def connect():
        def send(t):
            return t.replace("Ana", "[NAME]"), len(t) > 300

        return send

    found = diff.by_service(spark.createDataFrame([(1, text)], "doc_id long, text string"), connect, limit=256)
    assert [r["start"] for r in found.orderBy("start").collect()] == [m.start() for m in re.finditer("Ana", text)]


def test_char_chunks_cover_the_text():
    text = "word " * 300
    parts = detect.char_chunks(text, 300)
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == len(text)
    assert all(a + len(x) > b for (a, x), (b, _) in zip(parts, parts[1:], strict=False))


def test_model_adapter_and_filters(spark):
    def load():
        return lambda batch: [[{"start": 0, "stop": 3, "label": "per", "confidence": 0.5}, {"start": 0, "stop": 2, "label": "MISC"}] for _ in batch]

    docs = spark.createDataFrame([(1, "Ana here"), (2, "")], "doc_id long, text string")
    found = detect.by_model(docs, load, "02-SPACY", 2, "SPACY")
    assert [(r["doc_id"], r["entity_type"], r["replacement"]) for r in found.collect()] == [(1, "NAME", "Ana")]
    types = spark.createDataFrame([("02-SPACY", "COMPANY")], "component string, entity_type string")
    assert detect.supported(found, types).count() == 0


def test_nms_keeps_the_best_of_a_run(spark):
    rows = [(1, 0, 10, 0, "NAME", 0.5), (1, 0, 9, 1, "NAME", 0.4), (1, 1, 10, 2, "NAME", 0.9), (1, 20, 25, 3, "NAME", None)]
    found = spark.createDataFrame(rows, "doc_id long, start int, stop int, ord int, entity_type string, confidence double")
    assert {r["ord"] for r in detect.suppressed(found, 0.8).collect()} == {0, 2, 3}  # (1, 10) has an IoU of exactly 0.8 with the head (0, 9)
    assert {r["ord"] for r in detect.suppressed(found, 0.7).collect()} == {2, 3}


def test_truncation_and_answers(spark):
    rows = [("a" * 100, "short", None, None, 1), ("a" * 100, "short.", None, None, 1), ("ab", "ab", "LENGTH", None, 1), ("ab", "ab", None, "5", 2), ("ab [N", "ab [N", None, "x", 2), ("ab", "a[N]", None, None, 2)]
    df = spark.createDataFrame(rows, "o string, m string, r string, h string, n int")
    got = [r[0] for r in df.select(responses.truncated(*[F.col(c) for c in "omrhn"])).collect()]
    assert got == [True, False, True, True, True, False]
    bodies = ['{"masked_text":"","text":"x"}', '{"choices":[{"message":{"content":"y"}}]}', "raw"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [r[0] for r in df.select(responses.masked_text(F.col("b"))).collect()] == ["x", "y", "raw"]
