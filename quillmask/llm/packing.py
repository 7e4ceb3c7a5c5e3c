"""Lexical retrieval packing: documents are packed into token windows next to documents that share their words.

Documents are dealt over shards of about `shard_tokens` tokens; each shard has a BM25 inverted index over its documents' tokens. A seed document opens a window; the
index returns its unused neighbours by score, which fill the window greedily; one that doesn't fit is cut and its rest
opens the next window. Where no neighbour shares a term, the next unused document goes on. So every window is full but a shard's last
tokens, which are cut into sequences whose lengths are powers of two and need no padding either.

Documents are dealt by content: each has a leading term, a weighted min-hash over its terms (weight: idf to the power of 6, terms of one document none), so two documents have
the same one with the probability of their weighted overlap, which rare common terms rule. Shards are ranges of leading terms; the documents of a term that fills several
shards are spread over them evenly. Document frequencies and the mean length are those of the whole table. The dealing depends on the documents alone,
not on partitions.

Each token of each document lies in exactly one piece. Texts are encoded once, where they are read; their ids (two bytes each where the
vocabulary allows) are written to the shared folder and shuffled once. A shard is cut off at twice its size, whatever comes, and index, windows and
checksums are made in one streaming pass, so a lost task is simply run again. The driver holds a few numbers for each entry of the vocabulary.

A query uses all of the seed's terms that other documents of the shard have as well, so scores are the BM25 of the whole document and every
document of the shard that shares a term with it can be returned.

Defined cases: null and empty texts consist of the end token; very long texts fill windows of their own; repeated rows are packed
each by itself; null ids are packed and keep a null id; ties of score go to the earlier document of the shard; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import ship, spread, stored, texts
from ._words import numbered, words_of
from .bpe import byte_letters

MARKS = np.isin(np.arange(256), list(punctuation.encode()))
LETTERS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Known:
    """Ids of words under the words' hashes: an open table of entries, whose ids lie one after another. Entry 0 stands for none; entry 1 is no word's and one id long."""

    def __init__(self, kind: np.dtype, slots: int = 1 << 16):
        self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.start, self.ids = np.array([0, 0, 1], np.int64), np.zeros(1, kind)
        self.n = 2

    def __len__(self) -> int:
        return self.n

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash its entry."""
        last = len(self.keys) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        out = self.entry[at]
        off = np.flatnonzero((self.keys[at] != hashes) & (out > 0))
        while len(off):  # to the next slot, until the hash or an empty one is found
            at[off] = (at[off] + 1) & last
            out[off] = self.entry[at[off]]
            off = off[(self.keys[at[off]] != hashes[off]) & (out[off] > 0)]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Distinct hashes that have no entry yet get the next ones."""
        n, used = self.n + len(hashes), int(self.start[self.n])
        self.start, self.ids = _roomy(self.start, n + 1), _roomy(self.ids, used + len(ids))
        self.start[self.n + 1 : n + 1] = used + np.cumsum(size)
        self.ids[used : used + len(ids)] = ids
        if 4 * n > 3 * len(self.keys):
            keys, entry = self.keys, self.entry
            slots = 1 << (2 * n).bit_length()
            self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            own = np.flatnonzero(entry)
            self._put(keys[own], entry[own])
        self._put(hashes, np.arange(self.n, n, dtype=np.int32))
        self.n = n

    def _put(self, hashes: np.ndarray, own: np.ndarray) -> None:
        last = len(self.keys) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        while len(own):  # of those that come to one empty slot one takes it; the others go to the next slot
            free = self.entry[at] == 0
            self.entry[at[free]] = own[free]
            got = self.entry[at] == own
            self.keys[at[got]] = hashes[got]
            hashes, own, at = hashes[~got], own[~got], (at[~got] + 1) & last


def _roomy(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy with room for more than n at its end."""
    return x if n <= len(x) else np.r_[x, np.zeros(n + n // 4 - len(x), x.dtype)]


class Merges:
    """Byte-pair encoding of many words at once: rows of symbols of one length make their best merge together and go on as rows one shorter."""

    NONE = (1 << 31) - 1

    def __init__(self, model: dict, kind: np.dtype):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = dict.fromkeys((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)
        a, b, made = np.array([*pairs], np.int32).reshape(-1, 3).T
        self.known, self.made = Known(kind, 1 << (4 * len(made)).bit_length()), np.r_[np.int32(0), np.int32(0), made]
        self.known.add(self.keys(a, b), made[:0], np.zeros(len(made), np.int64))  # entries are ranks
        letters = byte_letters()
        self.inner, self.last = (np.array([vocab[letters[b] + x] for b in range(256)], np.int32) for x in ("", suffix))
        # Ranks of two bytes inside a word, and of a word's last two.
        self.early, self.late = (self.ranks(np.repeat(self.inner, 256), np.tile(x, 256)) for x in (self.inner, self.last))
        self.kind = kind

    @staticmethod
    def keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Another number for each pair, its low bits well mixed."""
        out = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return out ^ out >> np.uint64(32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.known.find(self.keys(a, b))
        out[out == 0] = self.NONE
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words (a first byte and a number of bytes, not 0) the ids one after another, and how many each has."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        own, symbols, ranks = np.empty(0, np.int64), np.empty((0, 0), np.int32), np.empty((0, 0), np.int32)
        for n in range(int(size.max(initial=0)), 0, -1):
            fresh = np.flatnonzero(size == n)
            raw = data[start[fresh, None] + np.arange(n)]
            more = self.inner[raw]
            more[:, -1] = self.last[raw[:, -1]]
            two = raw[:, :-1] * np.int32(256) + raw[:, 1:]
            early = self.early[two]
            early[:, -1:] = self.late[two[:, -1:]]
            if not len(own):
                symbols, ranks = np.empty((0, n), np.int32), np.empty((0, n - 1), np.int32)
            own, symbols, ranks = np.r_[own, fresh], np.vstack([symbols, more]), np.vstack([ranks, early])
            if not len(own):
                continue
            if n == 1:
                done.append((own, symbols))
                break
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(own)), at]
            going = best < self.NONE
            done.append((own[~going], symbols[~going]))
            own, at, best = own[going], at[going], best[going]
            row = np.arange(len(own))
            symbols = symbols[going][np.arange(n) != at[:, None] + 1].reshape(len(row), n - 1)
            ranks = ranks[going][np.arange(n - 1) != at[:, None]].reshape(len(row), n - 2)
            symbols[row, at] = self.made[best]
            left, right = at > 0, at < n - 2
            ranks[row[left], at[left] - 1] = self.ranks(symbols[row[left], at[left] - 1], symbols[row[left], at[left]])
            ranks[row[right], at[right]] = self.ranks(symbols[row[right], at[right]], symbols[row[right], at[right] + 1])
        count = np.zeros(len(size), np.int64)
        for at, found in done:
            count[at] = found.shape[1]
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), self.kind)
        for at, found in done:
            out[first[at, None] + np.arange(found.shape[1])] = found
        return out, count


def _spread_out(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of ranges one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Pieces of these sizes as a binary array."""
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Words:
    """Ids of white-space separated words, which a tokenizer without context across spaces encodes each alone.

    Words are known by 64-bit hashes and remembered from batch to batch, a bounded number of them. Of new ones, a word of Latin letters, perhaps with ASCII
    punctuation after it, is one or two pre-tokens: a batch's distinct ones come straight from the model's merges, all at once. All other words go through the
    whole tokenizer.
    """

    #: Longer words aren't encoded many at once, so that a few can't fill the memory.
    LONGEST = 64

    def __init__(self, path: str, remember: int = 300_000, most: int = 1_250_000):
        """remember: other words and marks that are kept as objects; most: words, and eight times as many ids, beyond which those known are forgotten."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.remember, self.most = remember, most
        self.merges = Merges(json.loads(self.tokenizer.to_str())["model"], self.kind)
        self.known: dict[bytes, bytes | None] = {}
        self.seen = Known(self.kind)

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def other(self, word: bytes) -> bytes:
        """Ids of any word or mark."""
        if (out := self.known.get(word)) is None:
            out = self.known[word] = self.packed(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return out

    @staticmethod
    def latin(word: bytes) -> bytes | None:
        """A word of Latin letters in lower case, none for other words."""
        text = word.decode("utf-8", "replace")
        if not text.isalpha() or max(text) >= "\u0250":
            return None
        low = text.lower()  # of a capital whose small form is a letter and a mark, no letters are left alone
        return low.encode() if low.isalpha() else None

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        n = len(words)
        edges = np.frombuffer(words.buffers()[1], np.int32, n + 1).astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if edges[-1] else np.empty(0, np.uint8)
        size = np.diff(edges)
        # The word without its punctuation, which may be all of it.
        body = np.maximum.reduceat(np.where(MARKS[data], 0, np.arange(1, len(data) + 1)), edges[:-1]) - edges[:-1] if n else size
        body = np.maximum(body, 0)
        # Letters from U+00C0 to U+00FF are C3 and a byte whose capitals lie 32 below (D7 and F7 are signs).
        after = np.r_[False, data[:-1] == 0xC3] & (data >= 0x80)
        data = np.where(after & (data < 0x9F), data + np.uint8(32), data)
        letters = np.r_[0, np.cumsum(LETTERS[data] | (data == 0xC3) | after & (data != 0xB7))]
        small = letters[edges[:-1] + body] - letters[edges[:-1]] == body
        ascii_ = np.r_[0, np.cumsum(data < 128)]
        plain = (body > 0) & (body <= self.LONGEST) & small
        maybe = (body > 0) & (body <= self.LONGEST) & ~small & (ascii_[edges[:-1] + body] - ascii_[edges[:-1]] < body)
        stems = [self.latin(data[a : a + b].tobytes()) for a, b in zip(edges[:-1][maybe].tolist(), body[maybe].tolist(), strict=True)]
        accented = np.flatnonzero(maybe)[[x is not None for x in stems]] if stems else np.empty(0, np.int64)
        stems = [x for x in stems if x is not None]
        bulk = np.r_[np.flatnonzero(plain), accented]
        source = pa.concat_arrays([_binary(data[_spread_out(edges[:-1][plain], body[plain])], body[plain]), pa.array(stems, pa.binary())]).dictionary_encode()
        fresh = source.dictionary
        at = np.frombuffer(fresh.buffers()[1], np.int32, len(fresh) + 1).astype(np.int64)
        ids, count = self.merges.encode(np.frombuffer(fresh.buffers()[2], np.uint8) if len(fresh) else data, at[:-1], np.diff(at))
        # Marks after those words, and all other words.
        tail = np.zeros(n, np.int64)
        tail[bulk] = size[bulk] - body[bulk]
        marked = np.flatnonzero(tail)
        marks = _binary(data[_spread_out(edges[1:][marked] - tail[marked], tail[marked])], tail[marked]).dictionary_encode()
        rest = np.ones(n, bool)
        rest[bulk] = False
        rest = np.flatnonzero(rest)
        others = map(self.other, words.take(pa.array(rest)).to_pylist())
        more = [*map(self.other, marks.dictionary.to_pylist()), *others, b""]
        sizes = np.r_[count, np.fromiter(map(len, more), np.int64, len(more)) // self.kind.itemsize]
        first, second = np.full(n, len(sizes) - 1), np.full(n, len(sizes) - 1)
        first[bulk] = source.indices.to_numpy()
        first[rest] = len(count) + len(marks.dictionary) + np.arange(len(rest))
        second[marked] = len(count) + marks.indices.to_numpy()
        both = np.column_stack([first, second]).ravel()  # the second is often empty
        ids = np.r_[ids, np.frombuffer(b"".join(more), self.kind)][_spread_out((np.cumsum(sizes) - sizes)[both], sizes[both])]
        return ids, sizes[first] + sizes[second]

    def encode(self, batch: pa.Array, end: int) -> tuple[np.ndarray, pa.Array]:
        """Of each text its number of ids, and its ids as bytes, with the end."""
        if len(self.known) > self.remember:
            self.known.clear()
        if len(self.seen) > self.most or len(self.seen.ids) > 8 * self.most:
            self.seen = Known(self.kind)
        w = words_of(batch)
        entry = self.seen.find(w.hash)
        entry[w.marks] = 1
        new = np.flatnonzero(entry == 0)
        if len(new):
            first, number = numbered(w.hash[new])
            entry[new] = len(self.seen) + number
            self.seen.add(w.hash[new[first]], *self.distinct(w.bytes_of(new[first])))
        self.seen.ids[0] = end
        start = self.seen.start[entry]
        size = self.seen.start[entry + 1] - start
        n = np.diff(np.r_[0, np.cumsum(size)[w.marks]])
        return n, _binary(self.seen.ids[_spread_out(start, size)].view(np.uint8), n * self.kind.itemsize)


@lru_cache(maxsize=2)
def loaded(path: str) -> Words:
    return Words(path)


class Shard:
    """BM25 index over the tokens of some documents."""

    def __init__(self, docs: list[np.ndarray], corpus: tuple[np.ndarray, float] | None = None, k1: float = 1.2, b: float = 0.75):
        """corpus: the idf of every term and the mean length over all documents; else those of docs."""
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs])
        top = int(max(d.max() for d in docs)) + 1
        keys, tf = np.unique(np.repeat(np.arange(self.n), lengths) * top + np.concatenate(docs), return_counts=True)
        doc, term = keys // top, keys % top
        df = np.bincount(term, minlength=top)
        idf, mean = corpus or (np.log1p((self.n - df + 0.5) / (df + 0.5)), lengths.mean())
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / mean))
        order = np.argsort(term, kind="stable")
        self.postings, self.weights, self.first = doc[order].astype(np.int32), weight[order].astype(np.float32), np.concatenate([[0], np.cumsum(df)])
        # Terms of many documents as rows with a weight for each document, which add up faster than postings; no more than 8 entries a posting, and 32 MB.
        many = np.flatnonzero(8 * df > self.n)
        many = many[np.argsort(-df[many], kind="stable")[: (1 << 22) // self.n]]
        self.row = np.full(top, -1)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), self.n))
        for r, t in enumerate(many):
            own = slice(self.first[t], self.first[t + 1])
            self.rows[r, self.postings[own]] = self.weights[own]
        shared = df[term] > 1
        self.query = np.split(term[shared].astype(np.int32), np.searchsorted(doc[shared], np.arange(1, self.n)))

    def scores(self, seed: int) -> np.ndarray:
        out = np.zeros(self.n)
        rows = self.row[self.query[seed]]
        for r in rows[rows >= 0]:
            out += self.rows[r]
        few = self.query[seed][rows < 0]
        at = _spread_out(self.first[few], self.first[few + 1] - self.first[few])
        return out + np.bincount(self.postings[at], self.weights[at], self.n)


def windows(docs: list[np.ndarray], size: int, corpus: tuple[np.ndarray, float] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length); all but the last ones are full, those have powers of two as lengths."""
    index = Shard(docs, corpus)
    unused = np.ones(len(docs), bool)
    cursor = 0
    rest: tuple[int, int] | None = None  # a document that was cut, and where it goes on
    window: list[tuple[int, int, int]] = []
    room = size
    seed, ranked = -1, iter(())

    def neighbours(i: int) -> Iterator[int]:
        s = index.scores(i)
        s[~unused] = 0
        for k in (16, len(s)):  # a window seldom takes more than a few
            best = np.argpartition(-s, k)[:k] if k < len(s) else np.arange(len(s))
            yield from (int(j) for j in best[np.lexsort((best, -s[best]))] if s[j] > 0 and unused[j])

    while True:
        if rest is not None:
            i, at = rest
        else:
            i = next(ranked, -1) if seed >= 0 else -1
            while i >= 0 and not unused[i]:
                i = next(ranked, -1)
            if i < 0:
                while cursor < len(docs) and not unused[cursor]:
                    cursor += 1
                if cursor == len(docs):
                    break
                i, seed = cursor, -1
            at = 0
            unused[i] = False
        if seed < 0:
            seed, ranked = i, neighbours(i)
        take = min(room, len(docs[i]) - at)
        window.append((i, at, take))
        room -= take
        rest = (i, at + take) if at + take < len(docs[i]) else None
        if not room:
            yield window
            window, room, seed = [], size, -1
    pieces = iter(window)
    left = size - room
    i, at, have = next(pieces, (0, 0, 0))
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        window = []
        while need:
            take = min(need, have)
            window.append((i, at, take))
            at, have, need = at + take, have - take, need - take
            if not have:
                i, at, have = next(pieces, (0, 0, 0))
        yield window


def _documents(ids: pa.Array, kind: str) -> list[np.ndarray]:
    """Views of the ids of each document."""
    edges = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset) // np.dtype(kind).itemsize if len(ids) else np.zeros(1, np.int32)
    flat = np.frombuffer(ids.buffers()[2], kind, edges[-1]) if edges[-1] else np.empty(0, kind)
    return [flat[a:b] for a, b in pairwise(edges.tolist())]


def _packer(size: int, most_tokens: int, kind: str, corpus):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        held, shard, sequence = 0, -1, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for window in windows(docs, size, corpus.value):
                offset = 0
                for i, start, length in window:
                    crc = zlib.crc32(docs[i][start : start + length].astype("<u4").tobytes())
                    rows.append((ids[i], start, length, crc, len(docs[i]), sequence, offset))
                    offset += length
                sequence += 1
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows.clear()
            yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in it:
            for d, k, x in zip(b.column("doc_id").to_pylist(), b.column("shard").to_pylist(), _documents(b.column("ids"), kind), strict=True):
                if docs and (k != shard or held >= most_tokens):
                    yield from out()
                    ids, docs, held = [], [], 0
                if k != shard:
                    shard, sequence = k, k << 32
                ids.append(d), docs.append(x)
                held += len(docs[-1])
        if docs:
            yield from out()

    return run


def _frequencies(kind: str, terms: int):
    """Rows (term, df) of some documents, and (-1, their number), (-2, their tokens)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens, last = np.zeros(terms, np.int64), 0, 0, np.zeros(terms, np.int64)
        for b in it:
            for ids in _documents(b.column("ids"), kind):
                place = np.arange(len(ids))
                last[ids] = place  # of several equal ids one is the last
                df[ids[last[ids] == place]] += 1
                n, tokens = n + 1, tokens + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1, -2]), pa.array(np.r_[df[some], n, tokens])], names=["term", "df"])

    return run


def leading(ids: np.ndarray, edges: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each document (ids between two edges) the least rank of its terms."""
    return np.minimum.reduceat(rank[ids], edges[:-1]) if len(edges) > 1 else np.empty(0, rank.dtype)


def ranks(idf: np.ndarray, df: np.ndarray, seed: int = 17) -> np.ndarray:
    """Places of the terms in a random order in which a term comes before others with a probability in proportion to the sixth power of its idf; terms of one document come last."""
    wait = np.random.default_rng(seed).exponential(size=len(idf)) / np.maximum(np.where(df > 1, idf, 0) ** 6, 1e-9)
    out = np.empty(len(idf), np.int32)
    out[np.argsort(wait)] = np.arange(len(idf))
    return out


def _led(rank, kind: str):
    """doc_id, n, ids with lead, the rank of the document's leading term."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column("ids")
            edges = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset).astype(np.int64) // np.dtype(kind).itemsize
            flat = np.frombuffer(ids.buffers()[2], kind, edges[-1]) if len(ids) else np.empty(0, kind)
            lead = leading(flat[edges[0] :], edges - edges[0], rank.value).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), ids, pa.array(lead)], names=["doc_id", "n", "ids", "lead"])

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 1, shard_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    from tokenizers import Tokenizer

    terms = max(Tokenizer.from_file(path).get_vocab_size(), end + 1)
    kind = "<u2" if terms <= 1 << 16 else "<u4"

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path)
        for b in it:
            n, ids = words.encode(b.column("text"), end)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), ids], names=["doc_id", "n", "ids"])

    encoded = stored(texts(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n long, ids binary"))
    found = {r["term"]: r["df"] for r in encoded.select("ids").mapInArrow(_frequencies(kind, terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row for each term at most
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(terms, np.int64)
    df[list(found)] = list(found.values())
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    corpus = spark.sparkContext.broadcast((idf, tokens / max(n, 1)))
    led = encoded.mapInArrow(_led(spark.sparkContext.broadcast(ranks(idf, df)), kind), "doc_id long, n long, ids binary, lead long")
    # Where the tokens of each leading term begin, if documents are laid out by it; a document's place among those of its term is random.
    room = np.zeros(terms, np.int64)
    for r in led.groupBy("lead").agg(F.sum("n").alias("n")).collect():  # a row for each term at most
        room[r["lead"]] = r["n"]
    shards = max(1, math.ceil(tokens / shard_tokens))
    begins = spark.createDataFrame([(int(i), int(a), int(b)) for i, a, b in zip(np.flatnonzero(room), (np.cumsum(room) - room)[room > 0], room[room > 0], strict=True)], "lead long, begins long, room long")
    place = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shard = F.least(F.floor((F.col("begins") + place * F.col("room")) / F.lit(float(max(tokens, 1))) * shards), F.lit(shards - 1)).cast("long")
    dealt = led.join(F.broadcast(begins), "lead").select("doc_id", "ids", "n", shard.alias("shard"))
    dealt = dealt.repartition(spread(docs), "shard").sortWithinPartitions("shard", "doc_id", "n", "ids")
    return dealt.select("doc_id", "shard", "ids").mapInArrow(_packer(size, 2 * shard_tokens, kind, corpus), PIECES)
