"""Operator 11: exact token counts of every prefix of a text.

The encoding of a prefix ends in one token, and what stands before that token is the
encoding of a shorter prefix. So the counts follow from a dynamic programme over the
prefixes of a pretoken: of the vocabulary's tokens that end at a place, the one that may
stand behind the last token of the shorter prefix is the last token there, and the count
is one more than there. Whether two tokens may stand side by side depends on the two
alone: no merge may join them across their border before they are whole.

All new pretokens of a piece of a partition are worked on together, prefix by prefix. A
stretch's table puts its pretokens' tables on top of each other, a text's table those of
its stretches (:mod:`tidemark.llm.stretches`). Questions about truncation and budgets are
then look-ups (:func:`tokens_before`, :func:`longest_within`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import SPLIT, Codec
from tidemark.llm.stretches import Stretches
from tidemark.llm.textkit import keep_learned, slices

SPACES = regex.compile(r"\s+")
#: Stretches whose white space depends on what follows it.
RUNS = regex.compile(r"\s\s|\s\Z")
#: Stretches, prefixes and pairs remembered between pieces of a partition; beyond them the memory starts anew.
MEMORY_UNITS = 400_000
MEMORY_PREFIXES = 16_000_000
MEMORY_PAIRS = 1_000_000
PIECE_BYTES = 2 << 20
#: The query's limit of tokens.
LIMIT = 512


class Tables:
    """Count tables in one array, by number."""

    def __init__(self) -> None:
        self.flat = np.zeros(0, np.int32)
        self.start = self.length = self.total = self.low = np.zeros(0, np.int64)

    def append(self, flat: np.ndarray, length: np.ndarray) -> None:
        first = np.cumsum(length) - length
        self.start = np.concatenate((self.start, len(self.flat) + first))
        self.length = np.concatenate((self.length, length))
        self.total = np.concatenate((self.total, flat[first + length - 1]))
        self.low = np.concatenate((self.low, np.minimum.reduceat(flat, first)))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def stacked(self, which: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables ``which``, ``per`` of them to a row, each on top of its row's earlier ones: (counts, lengths of the rows)."""
        base, _ = self.bases(which, per)
        sizes = self.length[which]
        edge = np.concatenate(([0], np.cumsum(sizes)))
        inner = self.flat[np.repeat(self.start[which] - edge[:-1], sizes) + np.arange(edge[-1])]
        stop = np.cumsum(per)
        return (inner + np.repeat(base, sizes)).astype(np.int32), edge[stop] - edge[stop - per]

    def bases(self, which: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of its row before each table, tokens of each row)."""
        edge = np.concatenate(([0], np.cumsum(self.total[which])))
        stop = np.cumsum(per)
        return edge[:-1] - np.repeat(edge[stop - per], per), edge[stop] - edge[stop - per]


class Beside(dict):
    """Whether two tokens may stand side by side, by pair.

    What stands at the border while both are built is looked at from the whole tokens
    down; the one that was made later is taken apart first. Of equal merges the leftmost
    is applied first.
    """

    def __init__(self, codec: Codec) -> None:
        self.size, self.rank = codec.size, codec.rank
        self.halves = {codec.merged[r]: (r, *pair) for r, pair in codec.pairs.items()}

    def __missing__(self, pair: int) -> bool:
        x, y = divmod(pair, self.size)
        x_until = y_until = len(self.rank)
        x_made, y_made = self.halves.get(x), self.halves.get(y)
        fit = True
        while True:
            r = self.rank.get(x * self.size + y)
            if r is not None and r < x_until and r <= y_until:
                fit = False
                break
            if x_made is not None and (y_made is None or x_made[0] > y_made[0]):
                x_until, x = x_made[0], x_made[2]
                x_made = self.halves.get(x)
            elif y_made is not None:
                y_until, y = y_made[0], y_made[1]
                y_made = self.halves.get(y)
            else:
                break
        self[pair] = fit
        return fit


class PrefixCounter:
    """Prefix tables of one byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        codec = Codec(path)
        self.size = codec.size
        if any(a != b and a in b for a in codec.added for b in codec.added):
            raise ValueError("a special token lies inside another one")
        # a tree of the tokens' bytes: inner nodes have a row of children each, other nodes none
        tree: list[dict[int, int]] = [{}]
        token = [-1]
        for k, piece in enumerate(codec.pieces):
            node = 0
            if k in codec.added.values():
                continue
            for b in piece:
                if b not in tree[node]:
                    tree[node][b] = len(tree)
                    tree.append({})
                    token.append(-1)
                node = tree[node][b]
            token[node] = k
        inner = [k for k, below in enumerate(tree) if below]
        self.row = np.full(len(tree), -1, np.int32)
        self.row[inner] = np.arange(len(inner))
        self.below = np.full((len(inner), 256), -1, np.int32)
        for k, node in enumerate(inner):
            self.below[k, list(tree[node])] = list(tree[node].values())
        self.token = np.array(token, np.int64)
        self.beside = Beside(codec)
        self.stretches = Stretches(codec.special, tuple(codec.added))
        self.forget()

    def forget(self) -> None:
        self.stretches.forget()
        self.units, self.words, self.word_number = Tables(), Tables(), {}

    def _matches(self, data: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(starts, width, tokens) of all tokens that stand in the bytes, by width; ``stop`` is where each byte's pretoken ends."""
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        width = 0
        while len(at):
            node = self.below[self.row[node], data[at + width]]
            width += 1
            on = node >= 0
            at, node = at[on], node[on]
            token = self.token[node]
            hit = token >= 0
            yield at[hit], width, token[hit]
            on = (self.row[node] >= 0) & (at + width < stop[at])
            at, node = at[on], node[on]

    def prefixes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of all prefixes of pretokens, by characters: (counts, how many each has)."""
        encoded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        data = np.frombuffer(b"".join(encoded), np.uint8)
        stop = np.repeat(np.cumsum(sizes), sizes)
        begin = stop - np.repeat(sizes, sizes)
        found = list(self._matches(data, stop))
        start = np.concatenate([s for s, _, _ in found])
        width = np.concatenate([np.full(len(s), w) for s, w, _ in found])
        token = np.concatenate([t for _, _, t in found])
        last_byte = start + width - 1
        # by length of the prefix, then place; the longest token first
        order = np.lexsort((-width, last_byte)) if len(data) > 1 << 30 else np.argsort((last_byte << 20) | ((1 << 20) - 1 - width))
        start, width, token, last_byte = start[order], width[order], token[order], last_byte[order]
        first = np.searchsorted(last_byte, np.arange(len(data) + 1))
        level = np.arange(len(data)) - begin
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 2))
        last, count = np.zeros(len(data), np.int64), np.zeros(len(data), np.int32)
        beside = self.beside.__getitem__
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            place = by_level[a:b]
            candidate = first[place]
            while len(place):
                s, t = start[candidate], token[candidate]
                whole = s == begin[place]
                before = s - 1
                fit = whole.copy()
                inner = np.flatnonzero(~whole)
                pairs = last[before[inner]] * self.size + t[inner]
                fit[inner] = np.fromiter(map(beside, pairs.tolist()), bool, len(pairs))
                done = place[fit]
                last[done] = t[fit]
                count[done] = np.where(whole[fit], 0, count[before[fit]]) + 1
                place, candidate = place[~fit], candidate[~fit] + 1
        ends = np.ones(len(data), bool)
        ends[:-1] = (data[1:] & 0xC0) != 0x80
        return count[ends], np.fromiter(map(len, words), np.int64, len(words))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of pretokens whose tables are known then.

        A contraction is one only when whole: until then it is a mark and a letter.
        """
        known = self.word_number
        fresh = list({w: None for w in words if w not in known})
        if fresh:
            counts, length = self.prefixes(fresh)
            edge = np.cumsum(length)
            for k, w in enumerate(fresh):
                known[w] = len(known)
                if w[0] == "'" and len(w) > 1 and w[1].isalpha():
                    counts[edge[k] - len(w) : edge[k] - 1] = np.arange(1, len(w))
            self.words.append(counts, length)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def table(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of one text without special tokens, by characters."""
        words: list[str] = []
        keep: list[tuple[int, int]] = []  # of each word: characters told before it, and the length after which the text goes on
        at = done = 0
        for piece in SPLIT.findall(text):
            begin, at = at, at + len(piece)
            run = SPACES.match(text, begin)
            if run is None or run.end() < at:
                words.append(piece)
                keep.append((done - begin, len(piece)))
                done = at
            elif done < at:  # white space at a prefix's end is one pretoken; its last character leaves it when a visible one follows
                words.append(run.group())
                keep.append((0, len(piece)))
                done = run.end()
                if done == len(text):
                    keep[-1] = (0, done - begin)
                    break
            elif text[begin] != " ":
                words.append(piece)
                keep.append((1, 1))
        own = self._numbers(words)
        out, base = [], 0
        for k, (told, on) in zip(own.tolist(), keep, strict=True):
            counts = self.words.flat[self.words.start[k] : self.words.start[k] + self.words.length[k]]
            out.append(counts[told:] + base)
            base += int(counts[on - 1])
        return np.concatenate(out)

    def _learn(self) -> None:
        fresh = self.stretches.texts[len(self.units.length) :]
        if not fresh:
            return
        slow = [isinstance(t, tuple) or t == "" or (t.split() != [t[t[0] == " " :]] and RUNS.search(t) is not None) for t in fresh]
        plain = [t for t, is_slow in zip(fresh, slow, strict=True) if not is_slow]
        # a line break between two stretches is a pretoken of its own
        words = SPLIT.findall("\n".join(plain))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        places = np.cumsum(sizes) - sizes
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        begins = np.cumsum(lengths + 1) - lengths - 1
        unit = np.searchsorted(begins, places, "right") - 1
        inside = places < (begins + lengths)[unit] if len(plain) else np.zeros(0, bool)
        numbers = self._numbers(words)
        per = np.bincount(unit[inside], minlength=len(plain))
        counts, sizes = self.words.stacked(numbers[inside], per)
        tables: list[np.ndarray] = []
        pieces = iter(np.split(counts, np.cumsum(sizes)[:-1])) if any(slow) else iter(())
        if not any(slow):
            self.units.append(counts, sizes)
            return
        for text, is_slow in zip(fresh, slow, strict=True):
            if not is_slow:
                tables.append(next(pieces))
            elif isinstance(text, tuple):
                tail, name = text
                own = self.table(tail + name)[len(tail) :] - (self.table(tail)[-1] if tail else 0)
                own[-1] = 1
                tables.append(own)
            else:
                tables.append(self.table(text) if text else np.zeros(1, np.int32))
        self.units.append(np.concatenate(tables), np.fromiter(map(len, tables), np.int64, len(tables)))

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts' stretches, how many each text has)."""
        if len(self.stretches.texts) > MEMORY_UNITS or len(self.units.flat) > MEMORY_PREFIXES or len(self.beside) > MEMORY_PAIRS:
            self.forget()
            self.beside.clear()
        units, per = self.stretches.rows(column)
        self._learn()
        empty = np.asarray(pc.fill_null(pc.binary_length(column), 0)) == 0
        if empty.any():
            keep = np.repeat(~empty, per)
            units, per = units[keep], np.where(empty, 0, per)
        return units, per

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token counts of every prefix of all texts, how many prefixes each text has)."""
        units, per = self.rows(column)  # which may begin the tables anew
        return self.units.stacked(units, per)

    def fitting(self, column: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, characters of its longest prefix of at most ``limit`` tokens)."""
        units, per = self.rows(column)
        base, whole = self.units.bases(units, per)
        chars = np.concatenate(([0], np.cumsum(self.units.length[units])))
        stop = np.cumsum(per)
        first = stop - per
        fit = chars[stop] - chars[first]
        for k in np.flatnonzero(whole > limit).tolist():
            a, b = first[k], stop[k]
            within = np.flatnonzero(base[a:b] + self.units.low[units[a:b]] <= limit)
            if not len(within):
                fit[k] = 0
                continue
            j = a + within[-1]
            at, size = self.units.start[units[j]], self.units.length[units[j]]
            fit[k] = chars[j] - chars[a] + np.flatnonzero(base[j] + self.units.flat[at : at + size] <= limit)[-1] + 1
        return whole, fit


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _parts(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[PrefixCounter, pa.RecordBatch]]:
    own = counter(path)
    keep_learned("token_counts", counter.cache_clear)
    for batch in batches:
        for part in slices(batch, "text", PIECE_BYTES, "token_counts"):
            yield own, part


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, counts) of every row of ``docs(doc_id, text)``: ``counts[i]`` are the tokens of the text's first i + 1 characters.

    Written as a table it answers truncation and budget questions without the texts.
    Tokens are those of the vocabulary file at ``path`` without added begin or end tokens;
    special tokens inside a text count as one, and before they are whole as ordinary text.
    A null or empty text has no tokens and no prefixes; a null doc_id is kept; repeated rows
    are counted each; other columns are ignored; texts of any length are whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in _parts(path, batches):
            counts, per = own.counts(part.column("text"))
            edge = np.concatenate(([0], np.cumsum(per)))
            total = np.concatenate(([0], counts))[np.where(per > 0, edge[1:], 0)]
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(counts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), lists], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, counts array<int>")


def tokens_before(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters by a stored table; beyond the text, of all of it."""
    return F.when(chars < 1, 0).otherwise(F.coalesce(F.get(counts, F.least(chars, F.size(counts)).cast("int") - 1), F.lit(0)))


def longest_within(counts: Column, limit: Column | int) -> Column:
    """Characters of the longest prefix of at most ``limit`` tokens by a stored table."""
    within = F.transform(F.reverse(counts), lambda k: k <= limit)
    place = F.array_position(within, True)
    return F.when(place > 0, F.size(counts) - place + 1).otherwise(0).cast("long")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every row of ``docs(doc_id, text)``.

    ``fit_chars`` are the characters of the longest prefix of at most ``limit`` tokens. The
    tables are those of :func:`prefix_counts`, asked where they are made, so that they
    need not move. Nulls, empty texts, repeats and other columns as there.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in _parts(path, batches):
            total, fit = own.fitting(part.column("text"), limit)
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(total, pa.int64()), pa.array(total > limit), pa.array(fit, pa.int64())], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
