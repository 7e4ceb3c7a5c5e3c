"""The masking service and its client, model adapters, selection of runs, names and plots."""

import io
import json
import threading
from urllib.error import URLError
from urllib.request import Request, urlopen

import pytest

from quillmask import logs
from quillmask.functions import names
from quillmask.operators import compare, detect, models
from quillmask.plans import config, pipeline, plots, selection
from quillmask.sources import runs, service


def test_service_over_http(spark):
    masker = service.Masker(spark, config.PipelineConfig(resolvers=[config.ResolverConfig()]))
    server = service.server(masker, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None):
        try:
            with urlopen(Request(base + path, json.dumps(body).encode() if body is not None else None), timeout=120) as r:
                return r.status, json.loads(r.read())
        except URLError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/healthz") == (200, {"status": "ok"}) and call("/readyz") == (503, {"status": "starting"})
        masker.warm_up()
        assert call("/readyz")[0] == 200 and call("/other")[0] == 404 and call("/other", {})[0] == 404
        status, got = call("/mask", {"doc_id": "c-1", "text": "mail a@b.com or b@c.org", "entity_cache": {"EMAIL": {"7": ["b@c.org"], "x": ["a@b.com"]}}})
        assert status == 200 and got["doc_id"] == "c-1" and got["masked_text"] == "mail [EMAIL8] or [EMAIL7]"
        assert got["entities"][0] == {"start": 5, "end": 12, "entity_type": "EMAIL", "id": "8", "confidence": 0.8, "replacement": "a@b.com"}
        assert call("/mask", {"text": ""})[1]["masked_text"] == "" and call("/mask", {"text": 3})[0] == 422 and call("/mask", [])[0] == 422
    finally:
        server.shutdown()
        server.server_close()


class Answer(io.BytesIO):
    def __init__(self, body, announced=None):
        super().__init__(body)
        self.headers = {"Content-Length": announced} if announced else {}


def test_client_reads_answers_and_waits():
    asked = []

    def opener(body, announced=None):
        def open_(request, timeout):
            asked.append(json.loads(request.data))
            return Answer(body, announced)

        return open_

    assert service.Client("http://x", opener=opener(b'{"masked_text": "[NAME] is here."}'))("Ana is here.") == ("[NAME] is here.", False)
    assert asked[-1] == {"text": "Ana is here.", "entity_types": ["NAME", "ADDRESS", "COMPANY"]}
    chat = b'{"choices": [{"message": {"content": "[NAME] is"}, "finish_reason": "LENGTH"}]}'
    assert service.Client("http://x", model="m", opener=opener(chat))("Ana is here.") == ("[NAME] is", True)
    assert asked[-1]["messages"][1] == {"role": "user", "content": "Ana is here."}
    assert service.Client("http://x", opener=opener(b"plain [NA"))("plain Ana") == ("plain [NA", True)
    assert service.Client("http://x", opener=opener(b"plain text.", "99"))("plain text.")[1]

    waits, tries = [], []

    def failing(text):
        tries.append(text)
        if len(tries) == 1:
            raise URLError("down")
        return "[NAME]", len(tries) == 2

    assert service.patiently(failing, 3, 0.5, waits.append)("Ana") == ("[NAME]", False) and waits == [0.5, 1.0]
    tries.clear(), waits.clear()
    with pytest.raises(URLError):
        service.patiently(failing, 0, 0.5, waits.append)("Ana")
    assert service.patiently(lambda t: ("x", True), 1, 0.5, waits.append)("Ana") == ("x", True) and waits == [0.5]


def test_models_by_windows(spark):
    text = "Ana met Bob. " * 3
    assert models.windows("", 4, 1) == [] and models.windows("a b", 4, 1) == [(0, 3)]
    assert [text[a:b] for a, b in models.windows(text, 5, 1)] == ["Ana met Bob. Ana", "Ana met Bob. Ana", "Ana met Bob."]

    def load():
        def predict(piece, labels, threshold):
            return [{"start": piece.find(x), "end": piece.find(x) + 3, "label": labels[0], "score": s} for x, s in (("Ana", 0.9), ("Bob", 0.7)) if x in piece and s >= threshold]

        return models.windowed(predict, ["person"], 0.6, 5, 1, 1)

    docs = spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc_id string, text string")
    cfg = config.DetectorConfig(type="GLINER")
    found = models.by_gliner(docs, cfg, "01-GLINER", 1, load)
    assert {(r["start"], r["stop"], r["entity_type"]) for r in found.collect()} == {(0, 3, "NAME"), (13, 16, "NAME"), (26, 29, "NAME")}
    assert {"SPACY", "GLINER", "HOSTED_MASKER_API", "REGEX"} <= set(pipeline.DETECTORS) and "MASKER_API" not in pipeline.DETECTORS
    assert detect.char_chunked(docs, 300, "string").count() == 1


def test_runs_are_chosen(spark, tmp_path):
    import os

    for n, (name, f1) in enumerate((("run-20240101T1-a", 0.1), ("run-20240102T1-b", 0.5), ("run-20240102T2-c", 0.75), ("run-20240102T3-d", 0.25))):
        (tmp_path / name).mkdir()
        rates = {"tp": 1, "fp": 1, "fn": 1, "precision": f1, "recall": f1, "f1": f1}
        path = tmp_path / name / "metrics.json"
        path.write_text(json.dumps({"run_id": name, "evaluation": {"exact": {"global_all_types": rates, "global_by_type": {"NAME": rates}}}}))
        os.utime(path, (1000 + n, 1000 + n))
    picked = lambda *named, **more: [p.name[-1] for p in selection.chosen([str(tmp_path / x) for x in named], tmp_path, **more)]
    assert picked() == ["b", "c", "d"] and picked(same_day=False) == ["c", "d"]
    assert picked("run-20240102T2-c") == ["d", "c"] and picked("run-20240102T2-c/metrics.json", "run-20240101T1-a") == ["c", "a"]
    assert picked("run-20240101T1-a", "run-20240102T1-b", "run-20240102T2-c") == ["a", "b", "c"]
    assert picked(baseline=str(tmp_path / "run-20240102T3-d")) == ["d", "c"] and picked("run-20240102T2-c", baseline=str(tmp_path / "run-20240101T1-a")) == ["a", "c"]
    with pytest.raises(ValueError):
        selection.chosen([], tmp_path / "run-20240101T1-a")
    assert selection.main(["--runs", str(tmp_path), "--out", str(tmp_path / "out")]) == 0
    report = json.loads(next((tmp_path / "out").glob("*.json")).read_text())
    assert report["baseline"] == "run-20240102T1-b" and {(r["run_id"][-1], r["delta"]) for r in report["rows"]} == {("c", 0.25), ("d", -0.25)}
    assert "hsl(" in next((tmp_path / "out").glob("*.html")).read_text()
    assert runs.rates(runs.read(spark, str(tmp_path / "*/metrics.json"))).count() == 8


def test_names_orders_and_logs(caplog):
    assert names.short_hash_of("abc") == "a9993e36" and names.snake_of("HTTPServerConfig2x") == "http_server_config2x"
    assert names.in_order({"masker": ["resolver"], "resolver": ["detector"], "writer": []}) == ["detector", "writer", "resolver", "masker"]
    with pytest.raises(ValueError):
        names.in_order({"a": ["b"], "b": ["a"]})
    logger = logs.set_up("debug")
    assert logger.level == 10 and len(logs.set_up("warning").handlers) == 1
    with pytest.raises(ValueError):
        logs.set_up("loud")
    record = logger.makeRecord("quillmask", 30, "f", 1, "one\ntwo", (), None)
    assert all("WARNING quillmask: " in line for line in logs.Lines().format(record).split("\n"))


def test_plots(spark):
    rows = spark.createDataFrame([("A", 3, 1, 0), ("B<", 1, 2, 5)], "entity_type string, tp long, fp long, fn long")
    stacked = plots.stacked(rows, "entity_type", ["tp", "fp", "fn"])
    assert {(r["entity_type"], r["part"], r["base"]) for r in stacked.collect()} == {("A", "tp", 0), ("A", "fp", 3), ("A", "fn", 4), ("B<", "tp", 0), ("B<", "fp", 1), ("B<", "fn", 3)}
    svg = plots.bars_svg(stacked, "counts")
    assert svg.count("<rect") == 6 and "B&lt;" in svg
    shares = spark.createDataFrame([(1, 0.5), (4, 1.0)], "size int, share double")
    assert 'points="40.0,160.0 600.0,' not in plots.cdf_svg(shares, "size", "x") and "<polyline" in plots.cdf_svg(shares, "size", "x")
    assert plots.bars_svg(plots.grouped(rows, "entity_type", "tp", "fp"), "g").count("<rect") == 2
    assert compare.PREFERRED[0] == "exact"
