"""Spans from a masked text: what stands between the literal parts of the masked text is what its tokens hide.

Tokens look like [NAME] or [NAME12], any case. White space is compared as single spaces. The scan is sequential (each literal is
searched from where the last one ended), so it runs as a function of one document in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.kinds import ALIASES
from .detect import SPANS, char_chunks

TOKEN = re.compile(r"\[([A-Z_]+)(\d*)\]", re.IGNORECASE)
STOPS, FARTHEST = ",;:.)", 512


def squeezed(text: str) -> tuple[str, list[int]]:
    """Runs of white space as one space, and each character's place in the text."""
    at, out = [], []
    for i, c in enumerate(text):
        if not c.isspace():
            out.append(c), at.append(i)
        elif not out or i == 0 or not text[i - 1].isspace():
            out.append(" "), at.append(i)
    return "".join(out), at


def _delimited(text: str, start: int) -> int:
    """The end of a span of unknown length: a delimiter before a space or the end, 512 characters at most."""
    for i in range(start, len(text)):
        if text[i] in STOPS and text[i + 1 : i + 2] in ("", " ") or i - start >= FARTHEST:
            return i
    return len(text)


def joined(found: list[tuple], text: str) -> list[tuple]:
    """(start, stop, type, id, confidence) sorted; overlapping ones extended into the first, which then has no confidence."""
    out: list[tuple] = []
    for s in sorted(found, key=lambda s: s[:2]):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[1] > out[-1][1]:
            out[-1] = (out[-1][0], s[1], *out[-1][2:4], None)
    return out


def spans_of(original: str, masked: str) -> list[tuple]:
    """(start, stop, type, id, confidence) of what the tokens hide."""
    tokens = list(TOKEN.finditer(masked))
    if not tokens:
        return []
    text, place = squeezed(original)
    place = [*place, len(original)]
    # Literal before each token, and after the last one.
    edges = [0, *(m.end() for m in tokens)]
    literals = [squeezed(masked[a:b])[0] for a, b in zip(edges, [*(m.start() for m in tokens), len(masked)], strict=True)]
    at, out = 0, []
    for n, m in enumerate(tokens):
        if literals[n] and (found := text.find(literals[n], at)) >= 0:
            at = found + len(literals[n])
        following = next((x for x in literals[n + 1 :] if x), "")
        stop = text.find(following, at) if following else -1
        stop = _delimited(text, at) if stop < 0 else stop
        a, b = (0 if at <= 0 else place[at]), place[stop] if stop > 0 else 0
        if a < b:
            name, number = m[1].upper(), m[2]
            out.append((a, b, ALIASES.get(name, name), (number.lstrip("0") or "0") if number else None, 1.0))
        at = stop
    return joined(out, original)


def by_service(docs: DataFrame, connect: Callable[[], Callable[[str], tuple[str, bool]]], component: str = "01-HOSTED_MASKER_API", comp_idx: int = 1, types: tuple[str, ...] = ("NAME", "ADDRESS", "COMPANY"), retries: int = 2, limit: int = 4000, id_type: str = "long") -> DataFrame:
    """Spans from a remote service: connect() runs once in each worker and gives text -> (masked text, cut off).

    A cut-off answer is asked for again `retries` times, then the text is sent in overlapping chunks whose spans are merged.
    """

    def ask(send: Callable[[str], tuple[str, bool]], text: str) -> tuple[str, bool]:
        for _ in range(retries + 1):
            masked, cut_off = send(text)
            if not cut_off:
                break
        return masked, cut_off

    def detect(send: Callable[[str], tuple[str, bool]], text: str) -> list[tuple]:
        masked, cut_off = ask(send, text)
        if not cut_off:
            return spans_of(text, masked)
        return joined([(s[0] + at, s[1] + at, *s[2:]) for at, part in char_chunks(text, limit) for s in spans_of(part, ask(send, part)[0])], text)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = connect()
        for part in it:
            rows = []
            for d, t in zip(part["doc_id"], part["text"], strict=True):
                kept = [s for s in detect(send, t or "") if s[2] in types]
                rows += [(d, component, comp_idx, i, s[0], s[1], s[2], s[3], t[s[0] : s[1]], s[4]) for i, s in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["doc_id", "component", "comp_idx", "det_idx", "start", "stop", "entity_type", "id", "replacement", "confidence"])

    return docs.select("doc_id", "text").mapInPandas(run, SPANS.format(id=id_type))


def diffs(answers: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start, stop, entity_type, id, confidence from doc_id, text, masked."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = [(d, *s) for d, t, m in zip(part["doc_id"], part["text"], part["masked"], strict=True) for s in spans_of(t or "", m or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "entity_type", "id", "confidence"])

    return answers.select("doc_id", "text", "masked").mapInPandas(run, f"doc_id {id_type}, start int, stop int, entity_type string, id string, confidence double")
