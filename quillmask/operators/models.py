"""Detectors that need a model or a service: their packages and weights are the cluster's to provide and are loaded once in each worker.

Each follows detect.by_model() or diff.by_service(); importing this module registers them with the pipeline.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import pipeline
from ..plans.config import DetectorConfig
from ..sources import service
from . import detect, diff

TOKENS = re.compile(r"\w+(?:[-_]\w+)*|\S")


def windows(text: str, size: int = 384, overlap: int = 50) -> list[tuple[int, int]]:
    """Character ranges of windows of `size` tokens, as detect.token_chunks() makes them."""
    at = [m.span() for m in TOKENS.finditer(text)]
    step, out, first = size - overlap, [], 0
    while at and (first == 0 or out[-1][1] < at[-1][1]):
        last = min(first + size, len(at)) - 1
        out.append((at[first][0], at[last][1]))
        first += step
    return out


def spacy_loader(model: str) -> Callable[[], Callable[[list[str]], list[list[dict]]]]:
    """Named entities of a spaCy pipeline, on a GPU if there is one; they have no confidence."""

    def load():
        import spacy

        spacy.prefer_gpu()
        nlp = spacy.load(model)
        return lambda texts: [[{"start": e.start_char, "stop": e.end_char, "label": e.label_, "confidence": None} for e in doc.ents] for doc in nlp.pipe(texts)]

    return load


def gliner_loader(model: str, labels: list[str], threshold: float, size: int, overlap: int, top_k: int) -> Callable[[], Callable[[list[str]], list[list[dict]]]]:
    """Entities of a GLiNER model by windows of tokens, the top_k most confident ones of each (0: all)."""

    def load():
        from gliner import GLiNER

        return windowed(GLiNER.from_pretrained(model).predict_entities, labels, threshold, size, overlap, top_k)

    return load


def windowed(predict: Callable, labels: list[str], threshold: float, size: int, overlap: int, top_k: int) -> Callable[[list[str]], list[list[dict]]]:
    """predict(text, labels, threshold=...) over windows, at places in the whole text."""

    def run(texts: list[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            found = []
            for a, b in windows(text, size, overlap):
                each = sorted(predict(text[a:b], labels, threshold=threshold), key=lambda e: -e["score"])
                found += [{"start": a + e["start"], "stop": a + e["end"], "label": e["label"], "confidence": float(e["score"])} for e in (each[:top_k] if top_k else each)]
            out.append(found)
        return out

    return run


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def by_spacy(docs: DataFrame, c: DetectorConfig, component: str, comp_idx: int) -> DataFrame:
    return detect.by_model(docs, spacy_loader(c.model), component, comp_idx, "SPACY", _id_type(docs))


def by_gliner(docs: DataFrame, c: DetectorConfig, component: str, comp_idx: int, load: Callable | None = None) -> DataFrame:
    load = load or gliner_loader(c.model, c.labels, c.threshold, c.max_length, c.chunk_overlap, c.top_k)
    found = detect.by_model(docs, load, component, comp_idx, "GLINER", _id_type(docs))
    found = detect.of_length(found, c.min_span_chars, c.max_span_chars).withColumn("ord", F.col("det_idx"))
    best = detect.suppressed(found, c.nms_iou).select("doc_id", F.col("ord").alias("det_idx"))
    return found.drop("ord").join(best, ["doc_id", "det_idx"], "left_semi").select(*[x for x in found.columns if x != "ord"])


def by_hosted(docs: DataFrame, c: DetectorConfig, component: str, comp_idx: int, url: str = "") -> DataFrame:
    """c.model is the service's address."""
    client = service.Client(url or c.model)
    return diff.by_service(docs, lambda: service.patiently(client, c.retries), component, comp_idx, retries=0, limit=c.chunk_char_limit, id_type=_id_type(docs))


pipeline.register("SPACY", by_spacy)
pipeline.register("GLINER", by_gliner)
pipeline.register("HOSTED_MASKER_API", by_hosted)
