"""BPE encoding and decoding with a given byte-level vocabulary.

Each pre-token is encoded by a priority queue of merge ranks over a doubly linked list of symbols: the pair of lowest rank
(leftmost on ties) is merged, its neighbours' new pairs are queued, and entries whose symbols have changed meanwhile are skipped
when they come up. Results of short pre-tokens are remembered per worker in a table of bounded size. Decoding concatenates
the vocabulary's byte strings.

Defined cases: a null or empty text has no tokens and decodes to the empty text; special tokens' strings inside a text become
their ids; very long pre-tokens take n log n steps; repeated rows and null ids are kept; an empty table gives an empty result;
other columns are ignored. The vocabulary's path is a parameter, read where each worker runs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._base import ship, texts

_SPACE = r"\p{White_Space}"
PRE_TOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class Bpe:
    """A vocabulary file of the tokenizers library, byte level without normaliser."""

    def __init__(self, path: str, remember: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.strings[i] = token.encode()
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.find = regex.compile(PRE_TOKEN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        queue = [(*merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        queue = [(rank, i, new, a, b) for rank, new, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: a symbol of this pair has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, found[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def packed(self, word: str) -> bytes:
        out = array("I", self.merge(word.encode("utf-8"))).tobytes()
        if len(word) <= 40:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split and any(s in text for s in self.specials):
            return b"".join(array("I", [self.specials[p]]).tobytes() if p in self.specials else self._plain(p) for p in self.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known, packed = self.known, self.packed
        return b"".join([known.get(w) or packed(w) for w in self.find(text)])

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in array("I", ids)]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def _runs(it: Iterator[pa.RecordBatch], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path)
    for b in it:
        ids = map(bpe.encode, b.column("text").to_pylist())
        if full:
            ids = list(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([array("I", x) for x in ids], pa.list_(pa.int64())), pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])
            continue
        out = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(bpe.decode(x).encode()).hexdigest()) for x in ids]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<bigint>, decoded."""
    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(lambda it: _runs(it, path, True), "doc_id long, ids array<bigint>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and texts stay in the worker."""
    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(lambda it: _runs(it, path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
