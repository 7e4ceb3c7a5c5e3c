"""Configuration, JSON lines, the whole pipeline, streaming and the entry point's queries."""

import json

import duckdb
import pytest

import __spark_entry__
from quillmask.operators import compare, evaluate
from quillmask.plans import catalog, config, pipeline, reports
from quillmask.sources import jsonl, runs
from quillmask.streaming import conversation

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    rows = lambda f: sorted(tuple(map(show, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_config_expands_lists_and_checks_values():
    found = config.expanded({"overlap": {"iou_threshold": [0.2, 0.5]}, "detectors": [{"type": "regex"}, {"type": ["spacy", "gliner"], "labels": ["a", "b"]}]})
    assert [(c.overlap.iou_threshold, c.detectors[1].type, c.detectors[1].labels) for c in found] == [(o, t, ["a", "b"]) for o in (0.2, 0.5) for t in ("SPACY", "GLINER")] or len(found) == 4
    for bad in ({"overlap": {"iou_threshold": 2}}, {"overlap": {"overlap_policy": "x"}}, {"mode": "x"}, {"nothing": 1}, {"masker": {"method": "x"}}, {"mode": "online", "masker": {"method": ["ASTERISK", "ENTITY_TAG"]}}):
        with pytest.raises(ValueError):
            config.expanded(bad)
    with pytest.raises(ValueError):
        config.expanded({"overlap": {"iou_threshold": [0.5] * 101}, "detectors": [{"type": "REGEX", "hierarchy_position": list(range(100))}]})


def test_command_line_overrides_file(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("masker: {method: ASTERISK}\n")
    (cfg,) = config.from_command_line(["--config", str(path), "--overlap.iou_threshold", "0.3"])
    assert cfg.masker.method == "ASTERISK" and cfg.overlap.iou_threshold == 0.3
    assert config.plain(cfg)["overlap"]["iou_threshold"] == 0.3


LINES = [
    {"doc_id": "d1", "text": "Ana writes from 10.0.0.1", "gold": [{"start": 16, "end": 24, "entity_type": "IPV4", "id": "1"}], "metadata": {"k": 1}},
    {"doc_id": "d2", "text": "placeholder", "gold": "##NAME;1;Ana@@ met ##COMPANY;;Acme@@."},
    {"doc_id": "d3", "text": "no gold"},
    {"doc_id": "d4", "text": "empty list", "gold": []},
    {"doc_id": "d5", "text": "replaced by its gold text", "gold": "mail a@b.com, no block"},
]


def read(spark, tmp_path, lines=LINES, **options):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return jsonl.read(spark, str(path), **options)


def test_documents_with_gold(spark, tmp_path):
    rows = {r["doc_id"]: r for r in read(spark, tmp_path, id_field="doc_id", gold_field="gold").collect()}
    assert [(s["entity_type"], s["start"], s["stop"], s["id"]) for s in rows["d2"]["gold"]] == [("NAME", 0, 3, "1"), ("COMPANY", 8, 12, None)]
    assert rows["d2"]["text"] == "Ana met Acme." and json.loads(rows["d1"]["metadata"]) == {"k": 1}
    assert rows["d3"]["gold"] is None and rows["d4"]["gold"] is None and rows["d5"]["gold"] == []
    assert [r["doc_id"] for r in read(spark, tmp_path).collect()] == [f"doc-{i}" for i in range(5)]
    with pytest.raises(Exception):
        read(spark, tmp_path, [{"text": ""}]).collect()
    assert read(spark, tmp_path, [{"text": ""}, "broken", {"text": "x"}], strict=False).count() == 1


def test_pipeline_end_to_end(spark, tmp_path):
    docs = read(spark, tmp_path, id_field="doc_id", gold_field="gold")
    (cfg,) = config.expanded({"detectors": [{"type": "REGEX", "priority": {"IPV4": 0}}], "resolvers": [{"threshold": 0.75}], "evaluator": {"enabled": True, "report_iou_thresholds": [0.5]}})
    result = pipeline.build(spark, cfg, docs)
    masked = {r["doc_id"]: r["masked_text"] for r in result.masked.collect()}
    assert masked["d1"] == "Ana writes from [IPV41]" and masked["d3"] == "no gold"
    summary = evaluate.summed(result.counts)
    total = summary.where("scope = 'global' and variant = 'exact' and entity_type is null").first()
    assert (total["tp"], total["fp"], total["fn"]) == (1, 1, 2)
    document = reports.metrics_document("run-20260101T000000-abcdef", result.spans, result.masked, summary, 2.0)
    assert document["spans_masked_total"] == 2 and document["evaluation"]["exact"]["global_all_types"]["tp"] == 1
    assert "| exact | global | all | 1 |" in reports.markdown(summary)
    jsonl.write(result.masked.join(docs.select("doc_id", "gold"), "doc_id"), str(tmp_path / "out.jsonl"))
    back = runs.processed(spark, str(tmp_path / "out.jsonl"))
    assert back.where("doc_id = 'd1'").first()["predicted_entities"][0]["end"] == 24
    folder = tmp_path / document["run_id"]
    folder.mkdir()
    (folder / "metrics.json").write_text(json.dumps(document))
    found = runs.read(spark, str(tmp_path / "run-*" / "metrics.json"))
    assert runs.rates(found).where("variant = 'exact' and entity_type is null").first()["f1"] == pytest.approx(0.4)
    assert compare.latest_day(found.select("run_id", "mtime")).first()["day"] == "20260101"
    assert compare.primary_variant(runs.rates(found)).first()["variant"] == "exact"
    assert "<td>global</td>" in reports.table_html(summary, "x < y")


def test_output_paths(tmp_path):
    (tmp_path / "o.jsonl").write_text("")
    assert reports.output_path(str(tmp_path / "o.jsonl"), "in.jsonl") != str(tmp_path / "o.jsonl")
    assert "in.results-" in reports.output_path("", "/x/in.jsonl")
    with pytest.raises(ValueError):
        reports.output_path("x.txt", "in.jsonl")


def test_cache_requests(spark):
    df = spark.createDataFrame([("c", '{"NAME":{"1":["Louise","Louise"],"x":["a"]}}')], "doc_id string, entity_cache string")
    assert [tuple(r) for r in jsonl.cache_entries(df).collect()] == [("c", "NAME", 1, "Louise")]


def test_stream_remembers_conversations(spark, tmp_path):
    schema = "conv_id long, turn long, ord int, entity_type string, mention string"
    turns = [[(1, 0, 0, "NAME", "Louise"), (1, 0, 1, "COMPANY", "Apple"), (1, 1, 0, "NAME", "Marcel")], [(1, 2, 0, "NAME", "Anna"), (1, 2, 1, "NAME", "Marcel"), (1, 3, 0, "NAME", "Louise"), (2, 0, 0, "NAME", "Zoe")]]
    everything = spark.createDataFrame([t for part in turns for t in part], schema)
    want = {tuple(r) for r in conversation.numbered(everything).collect()}
    for n, part in enumerate(turns):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = conversation.numbered_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
