"""A masking service over HTTP, and a client of one.

The service runs the pipeline's plan on a frame of one document per request; the caller holds the cache of entities. The client asks a
remote service for masked texts, tells cut-off answers, and waits longer after each failure.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import URLError
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

from ..plans import pipeline
from ..plans.config import PipelineConfig
from . import jsonl

PROMPT = "Replace each of these kinds of entities in the user's text by its name in square brackets and leave everything else as it is: {types}."


def patiently(send: Callable[[str], tuple[str, bool]], retries: int = 2, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str, bool]]:
    """send (text -> masked text, cut off), asked again after an error or a cut-off answer; the pause doubles each time. The last answer or error counts."""

    def ask(text: str) -> tuple[str, bool]:
        for attempt in range(retries + 1):
            last = attempt == retries
            try:
                masked, cut_off = send(text)
                if last or not cut_off:
                    return masked, cut_off
            except URLError:
                if last:
                    raise
            sleep(pause * 2**attempt)
        raise AssertionError("no attempt was made")

    return ask


def answer_of(body: str) -> tuple[str, str | None]:
    """The masked text of a JSON or plain answer, and why a chat model stopped."""
    try:
        found = json.loads(body)
    except ValueError:
        return body, None
    if not isinstance(found, dict):
        return body, None
    choice = (found.get("choices") or [{}])[0]
    said = (choice.get("message") or {}).get("content")
    text = next((x for x in (found.get("masked_text"), found.get("maskedText"), found.get("text"), said) if x), body)
    return text, choice.get("finish_reason")


def cut_off(original: str, masked: str, reason: str | None, announced: int | None, received: int, fraction: float = 0.6) -> bool:
    """The rule of functions.responses.truncated() for one answer."""
    if (reason or "").lower() in ("length", "max_tokens", "maxtokens") or announced is not None and announced > received:
        return True
    short = 0 < len(masked) < fraction * len(original) and masked[-64:].rstrip(" ")[-1:] not in tuple(".!?)]")
    return short or "[" in masked and not masked.rstrip(" ").endswith("]") and "]" not in masked.rpartition("[")[2]


@dataclass(frozen=True)
class Client:
    """text -> (masked text, cut off). With a model, a chat service is asked, else one that takes a text."""

    url: str
    model: str = ""
    types: tuple[str, ...] = ("NAME", "ADDRESS", "COMPANY")
    headers: dict = field(default_factory=dict)
    timeout: float = 30.0
    options: dict = field(default_factory=dict)
    opener: Callable = urlopen

    def __call__(self, text: str) -> tuple[str, bool]:
        if self.model:
            said = [{"role": "system", "content": PROMPT.format(types=", ".join(self.types))}, {"role": "user", "content": text}]
            payload = {"model": self.model, "messages": said, **self.options}
        else:
            payload = {"text": text, "entity_types": list(self.types)}
        headers = {"Content-Type": "application/json", "Accept": "application/json", **self.headers}
        with self.opener(Request(self.url, json.dumps(payload).encode("utf-8"), headers, method="POST"), timeout=self.timeout) as answer:
            raw, announced = answer.read(), answer.headers.get("Content-Length")
        masked, reason = answer_of(raw.decode("utf-8", "replace"))
        return masked, cut_off(text, masked, reason, int(announced) if announced and announced.isdigit() else None, len(raw))


@dataclass
class Masker:
    """Requests {doc_id?, text, entity_cache?} to answers {doc_id, masked_text, entities}."""

    spark: SparkSession
    cfg: PipelineConfig
    ready: bool = False

    def warm_up(self) -> None:
        self({"text": "warm-up"})
        self.ready = True

    def __call__(self, request: dict) -> dict:
        if not isinstance(request.get("text"), str):
            raise ValueError("a request needs a text")
        doc_id = str(request.get("doc_id") or f"req-{uuid.uuid4()}")
        row = (doc_id, request["text"], json.dumps(request.get("entity_cache") or {}))
        docs = self.spark.createDataFrame([row], "doc_id string, text string, entity_cache string")
        cache = jsonl.cache_entries(docs) if request.get("entity_cache") else None
        done = pipeline.build(self.spark, self.cfg, docs.select("doc_id", "text"), cache).masked.first()
        entities = [{"start": e["start"], "end": e["stop"], "entity_type": e["entity_type"], "id": e["id"], "confidence": e["confidence"], "replacement": e["replacement"]} for e in done["entities"] or ()]
        return {"doc_id": doc_id, "masked_text": done["masked_text"], "entities": entities}


def server(masker: Masker, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """POST /mask; GET /healthz is always well, GET /readyz once the masker is warm. The caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def say(self, status: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path == "/healthz":
                self.say(200, {"status": "ok"})
            elif self.path == "/readyz":
                self.say(*((200, {"status": "ready"}) if masker.ready else (503, {"status": "starting"})))
            else:
                self.say(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path != "/mask":
                return self.say(404, {"error": "not found"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                answer = masker(request)
            except (ValueError, AttributeError) as e:
                return self.say(422, {"error": str(e)})
            self.say(200, answer)

        def log_message(self, *args) -> None:
            """Texts of requests stay out of logs."""

    return ThreadingHTTPServer((host, port), Handler)
