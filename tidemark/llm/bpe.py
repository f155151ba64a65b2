"""Operator 6: byte-level BPE with a pair occurrence index.

The distinct pretokens of a piece of a partition are laid out as one symbol
array. An index maps each adjacent pair to all its positions there; ranks that
occur are applied in ascending order, each to all its positions at once, and the
lists of the neighbouring pairs are updated. Every text is then put together from
its pretokens' ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import keep_learned, slices

#: Fixed value: the split pattern of byte-level BPE vocabularies.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beside a space: there the pieces between spaces are not units of their own.
AMBIGUOUS = regex.compile(r" \s|\s |^ | $")
#: Units remembered between pieces of a partition; beyond it the memory starts anew.
MEMORY_UNITS = 200_000
PIECE_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Units:
    """The distinct stretches of text seen so far, by number."""

    def __init__(self) -> None:
        self.text: list[str] = []

    def add(self, text: str) -> int:
        self.text.append(text)
        return len(self.text) - 1


class Numbers(dict):
    """Numbers of units that stand behind ``lead``; unknown ones get the next number."""

    def __init__(self, units: Units, lead: str) -> None:
        self.units, self.lead = units, lead

    def __missing__(self, text: str) -> int:
        self[text] = k = self.units.add(self.lead + text)
        return k


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.pieces: list[bytes] = [b""] * size
        for text, k in vocab.items():
            self.pieces[k] = bytes(alphabet[c] for c in text)
        for text, k in self.added.items():
            self.pieces[k] = text.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        self.size = size
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = vocab[left] * size + vocab[right]
            if key not in self.rank:
                self.rank[key] = len(self.merged)
            self.merged.append(vocab[left + right])
        self.pairs = {r: divmod(key, size) for key, r in self.rank.items()}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._forget()

    def _ranks(self, pair: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.key_rank[at], -1)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word, all words at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        symbol = self.of_byte[data]
        ends = np.cumsum(lengths)
        follow = np.arange(1, n + 1)
        follow[ends - 1] = n
        before = np.arange(-1, n - 1)
        before[ends - lengths] = -1
        alive = np.ones(n + 1, bool)
        left = np.flatnonzero(follow < n)
        rank = self._ranks(symbol[left] * self.size + symbol[follow[left]])
        left, rank = left[rank >= 0], rank[rank >= 0]
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = ranks[np.concatenate(([0], cut))].tolist()
            for r, group in zip(firsts, np.split(places, cut), strict=True):
                held = index.get(r)
                if held is None:
                    index[r] = [group]
                    heapq.heappush(queue, r)
                else:
                    held.append(group)

        add(left, rank)
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            a, b = self.pairs[r]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[alive[at]]
            nxt = follow[at]
            ok = (symbol[at] == a) & (nxt < n)
            at, nxt = at[ok], nxt[ok]
            at, nxt = at[symbol[nxt] == b], nxt[symbol[nxt] == b]
            if a == b and len(at) > 1:  # of overlapping places in a run, every other one from its left end
                at = at[_every_other(at, nxt)]
                nxt = follow[at]
            if not len(at):
                continue
            symbol[at] = self.merged[r]
            alive[nxt] = False
            after = follow[nxt]
            follow[at] = after
            inner = after < n
            before[after[inner]] = at[inner]
            has = before[at] >= 0
            places = np.concatenate((before[at][has], at[inner]))
            places = np.unique(places) if len(places) > 1 else places
            ranks = self._ranks(symbol[places] * self.size + symbol[follow[places]])
            add(places[ranks >= 0], ranks[ranks >= 0])
        kept = alive[:n]
        ids = symbol[kept]
        counts = np.add.reduceat(kept, ends - lengths) if n else np.zeros(0, np.int64)
        return np.split(ids, np.cumsum(counts)[:-1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        if len(self.units.text) > MEMORY_UNITS:
            self._forget()
        known, lone, spaced = len(self.units.text), self.lone.__getitem__, self.spaced.__getitem__
        rows: list[list[int]] = []
        for text in texts:
            parts = self.special.split(text) if self.special is not None and any(x in text for x in self.added) else [text]
            row: list[int] = []
            for part in parts:
                if part in self.added:
                    row.append(self.marks[part])
                elif part and not AMBIGUOUS.search(part):
                    # no pretoken crosses a single space between visible characters
                    first, *rest = part.split(" ")
                    row.append(lone(first))
                    row.extend(map(spaced, rest))
                elif part:
                    row.extend(map(lone, SPLIT.findall(part)))
            rows.append(row)
        self._learn(self.units.text[known:])
        per = np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.concatenate([np.array(row, np.int64) for row in rows]) if rows else np.zeros(0, np.int64)
        sizes = self.length[order]
        edge = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.start[order] - edge[:-1], sizes) + np.arange(edge[-1])]
        stop = np.cumsum(per)
        return ids, edge[stop] - edge[stop - per]

    def _forget(self) -> None:
        self.units = Units()
        self.lone, self.spaced = Numbers(self.units, ""), Numbers(self.units, " ")
        self.flat, self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.words: dict[str, np.ndarray] = {}
        self.marks = {}
        for text, k in self.added.items():
            self.marks[text] = self.units.add("")
            self._append([np.array([k])])

    def _append(self, tables: list[np.ndarray]) -> None:
        length = np.fromiter(map(len, tables), np.int64, len(tables))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.flat = np.concatenate((self.flat, *tables))

    def _learn(self, fresh: list[str]) -> None:
        if not fresh:
            return
        split = [SPLIT.findall(unit) for unit in fresh]
        words = list({w: None for row in split for w in row if w not in self.words})
        if words:
            self.words.update(zip(words, self.merge([w.encode() for w in words]), strict=True))
        known = self.words
        self._append([known[row[0]] if len(row) == 1 else np.concatenate([known[w] for w in row]) for row in split])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _every_other(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Which sorted places to merge where a place's successor may be the next place."""
    chained = np.concatenate(([False], nxt[:-1] == at[1:]))
    head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    return (np.arange(len(at)) - head) % 2 == 0


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _round_trip(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        keep_learned("bpe", codec.cache_clear)
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES, "bpe"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, counts = bpe.encode(texts)
                edge = np.concatenate(([0], np.cumsum(counts)))
                decoded = [bpe.decode(ids[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded)], schema=schema)

    return run


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs(doc_id, text)``.

    ``path`` names a byte-level BPE vocabulary file that every executor can read.
    A null or empty text has no ids and decodes to the empty text; a null doc_id
    is kept; repeated rows are encoded each; other columns are ignored; texts of any
    length are whole (one text is one unit of work). Special tokens that stand in a
    text are recognised, none is added, and nothing is truncated or padded.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_round_trip(path), "doc_id long, ids array<int>, decoded string")


def _digests(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    trip = _round_trip(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in trip(batches):
            lists = part.column("ids")
            values, edge = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            ids = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in spans]
            text = [hashlib.sha256(t.encode()).hexdigest() for t in part.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([b - a for a, b in spans], pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], schema=schema)

    return run


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """The round trip of :func:`bpe_round_trip` as counts and SHA-256 digests, without moving ids to the JVM."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
