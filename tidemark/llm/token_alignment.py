"""Operator 13: which tokens of two tokenizers cover the same bytes.

Token ends are bits over the bytes of the text, packed; what both bitsets have are the
shared cuts. The rank of a cut among the ends of one tokenizer, by counted bits of the
words before it, says how many of its tokens lie before the cut, so that two cuts give
a range of tokens on either side, a group. All pairs of a group are links.

Both tokenizers end a token at the ends of the stretches of :mod:`tidemark.llm.stretches`, so
groups lie within stretches, and each new stretch is tokenised and aligned once; texts
are put together from them and written with their linked pairs of ids. How many
documents hold a pair is counted from there. The most frequent pairs, up to a fixed
number, reach all tasks as one packed table; the documents' other pairs meet their counts
in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_alphabet
from tidemark.llm.stretches import Stretches
from tidemark.llm.textkit import keep_learned, slices
from tidemark.session import discard, materialise

#: Pairs of ids whose counts are sent to all tasks at most; the others are joined.
SENT_PAIRS = 1 << 20
#: Stretches tokenised in a row.
RUN = 500
#: Stretches and links remembered between pieces of a partition; beyond them the memory starts anew.
MEMORY_UNITS = 300_000
MEMORY_LINKS = 8_000_000
PIECE_BYTES = 2 << 20

_BYTE = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}


class Bitset:
    """Bits over byte places, packed into words, with rank by counted bits."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def of(places: np.ndarray, size: int) -> Bitset:
        bits = np.zeros((size + 64) // 64 * 64, bool)
        bits[places] = True
        return Bitset(np.packbits(bits, bitorder="little").view(np.uint64))

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.words & other.words)

    def places(self) -> np.ndarray:
        """The set places in order (select)."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set up to and with each place."""
        before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = self.words[word] & (~np.uint64(0) >> (np.uint64(63) - bit))
        return before[word] + np.bitwise_count(upto)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 of each size in a row."""
    edge = np.cumsum(sizes)
    return np.arange(edge[-1] if len(edge) else 0) - np.repeat(edge - sizes, sizes)


def _ids_of_groups(ids: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) of the ids of consecutive groups, sorted by group."""
    key, times = np.unique((np.repeat(np.arange(len(inner)), inner) << 32) | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


def align(size: int, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, tokens of A up to each, tokens of B up to each) from the byte places of the tokens' last bytes."""
    a, b = Bitset.of(a_ends, size), Bitset.of(b_ends, size)
    cuts = (a & b).places()
    return cuts, a.rank(cuts), b.rank(cuts)


class Pieces:
    """The bytes of a vocabulary's tokens, and ids put back to bytes."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.size[ids]
        return self.flat[np.repeat(self.start[ids], sizes) + _ranges(sizes)]


class Aligner:
    """Both vocabularies, and the alignment of every stretch seen."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        a_pieces = [b""] * (max(self.a.get_vocab().values()) + 1)
        for text, k in vocab.items():
            a_pieces[k] = bytes(alphabet[c] for c in text)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in b_names):
            raise ValueError("a piece holds a space behind a visible character")
        b_pieces = [_BYTE[p] if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(b_names)]
        self.pieces = Pieces(a_pieces), Pieces(b_pieces)
        self.width, self.span = len(b_pieces), len(a_pieces) * len(b_pieces)
        digits = [b"%d," % k for k in range(max(len(a_pieces), len(b_pieces)))]
        self.digits = Pieces(digits)
        self.stretches = Stretches()
        self.forget()

    def forget(self) -> None:
        self.stretches.forget()
        self.good = np.zeros(0, bool)
        self.groups: list[bytes] = []
        self.n_a = self.n_b = self.n_groups = self.n_links = self.n_pairs = self.first = np.zeros(0, np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids by A, ids by B, both of the texts that both give back, one after the other), and which those are; each text begins with the added space."""
        rows = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, stop = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
        good, out = np.ones(len(texts), bool), []
        for pieces, own in zip(self.pieces, rows, strict=True):
            per = np.fromiter(map(len, own), np.int64, len(own))
            ids = np.fromiter(chain.from_iterable(own), np.int64, int(per.sum()))
            text = np.repeat(np.arange(len(own)), per)
            long = np.bincount(text, pieces.size[ids], minlength=len(own)).astype(np.int64)
            good &= long == sizes
            fit = good[text]
            back = pieces.joined(ids[fit])
            same = back == flat[np.repeat(good, sizes)]
            wrong = np.searchsorted(np.cumsum(np.where(good, sizes, 0)), np.flatnonzero(~same), "right")
            good[wrong] = False
            out.append((ids, text))
        return [ids[good[text]] for ids, text in out], good

    def _learn(self) -> None:
        texts = self.stretches.texts[len(self.good) :]
        if not texts:
            return
        lone = set(self.stretches.lone.values())
        spaced = [f" {t}" if k in lone else t for k, t in enumerate(texts, len(self.good))]
        alone = self.stretches.odd[len(self.good) :].tolist()
        # stretches follow each other as in a text; those with white space at an end stand alone, and those of a run that is not given back
        runs = [k for k, odd in enumerate(alone) if not odd]
        runs = [runs[i : i + RUN] for i in range(0, len(runs), RUN)]
        ids, good = self._encoded(["".join(spaced[k] for k in run) for run in runs])
        placed = [k for run, fine in zip(runs, good.tolist(), strict=True) if fine for k in run]
        rest = [k for k, odd in enumerate(alone) if odd] + [k for run, fine in zip(runs, good.tolist(), strict=True) if not fine for k in run]
        if rest:
            more, good = self._encoded([spaced[k] for k in rest])
            ids = [np.concatenate(x) for x in zip(ids, more, strict=True)]
            placed += [k for k, fine in zip(rest, good.tolist(), strict=True) if fine]
        self._align(len(texts), placed, np.cumsum(np.fromiter((len(spaced[k].encode()) for k in placed), np.int64, len(placed))), *ids)

    def _align(self, n: int, placed: list[int], stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Takes up ``n`` stretches: ``placed`` are the numbers of those with tokens, which end before the bytes ``stop``."""
        a_end, b_end = (np.cumsum(pieces.size[ids]) - 1 for pieces, ids in zip(self.pieces, (a, b), strict=True))
        cuts, a_upto, b_upto = align(int(stop[-1]) if len(stop) else 0, a_end, b_end)
        a_in, b_in = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
        place = np.searchsorted(stop, cuts, "right")  # of each group: which of the placed stretches
        last = np.flatnonzero(np.diff(place, append=len(placed)))
        if len(last) != len(placed) or (cuts[last] != stop - 1).any():
            raise ValueError("a token crosses the end of a stretch")
        owner = np.array(placed, np.int64)[place]
        # links expand: every id of A in a group with every id of B, as often as both occur there
        (a_group, a_id, a_times), (b_group, b_id, b_times) = (_ids_of_groups(ids, inner) for ids, inner in ((a, a_in), (b, b_in)))
        b_count = np.bincount(b_group, minlength=len(cuts))
        b_first = np.cumsum(b_count) - b_count
        many = b_count[a_group]
        left = np.repeat(np.arange(len(a_id)), many)
        right = b_first[a_group[left]] + _ranges(many)
        keys, times = _summed(owner[a_group[left]] * self.span + a_id[left] * self.width + b_id[right], a_times[left] * b_times[right])
        unit, pair = np.divmod(keys, self.span)
        n_pairs = np.bincount(unit, minlength=n)
        count = {"n_a": np.bincount(owner, a_in, n), "n_b": np.bincount(owner, b_in, n), "n_groups": np.bincount(owner, minlength=n), "n_links": np.bincount(owner, a_in * b_in, n), "n_pairs": n_pairs}
        self._write(n, placed, last, a, b, a_upto, b_upto, a_in, b_in)
        good = np.zeros(n, bool)
        good[placed] = True
        self.good = np.concatenate((self.good, good))
        self.first = np.concatenate((self.first, len(self.pair) + np.cumsum(n_pairs) - n_pairs))
        for name, own in (count | {"pair": pair, "times": times}).items():
            setattr(self, name, np.concatenate((getattr(self, name), own.astype(np.int64))))

    def _write(self, n, placed, last, a, b, a_upto, b_upto, a_in, b_in) -> None:
        """The text ``a1,a2|b1;a3|b2,b3`` of each stretch: every id with a comma, the last of a side with its mark."""
        ids = np.zeros(len(a) + len(b), np.int64)
        group = np.arange(len(a_in))
        ids[np.arange(len(a)) + np.repeat(b_upto - b_in, a_in)] = a
        ids[np.arange(len(b)) + np.repeat(a_upto, b_in)] = b
        out = self.digits.joined(ids)
        stop = np.cumsum(self.digits.size[ids])
        out[stop[a_upto + (b_upto - b_in)[group] - 1] - 1] = ord("|")
        ends = stop[a_upto + b_upto - 1]
        out[ends - 1] = ord(";")
        whole, ends = out.tobytes(), ends[last].tolist()
        texts = [b""] * n
        begin = 0
        for k, end in zip(placed, ends, strict=True):
            texts[k] = whole[begin : end - 1]
            begin = end
        self.groups.extend(texts)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the stretches of all texts that have tokens, how many each text has)."""
        if len(self.stretches.texts) > MEMORY_UNITS or len(self.pair) > MEMORY_LINKS:
            self.forget()
        units, per = self.stretches.rows(column)
        self._learn()
        row = np.repeat(np.arange(len(per)), per)
        lost = np.asarray(pc.fill_null(pc.binary_length(column), 0)) == 0
        lost[row[~self.good[units]]] = True
        return units[~lost[row]], np.where(lost, 0, per)

    def links(self, units: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of ids, their links, first pair of each row and the end) of rows of stretches, summed by row and pair."""
        sizes = self.n_pairs[units]
        at = np.repeat(self.first[units], sizes) + _ranges(sizes)
        row = np.repeat(np.repeat(np.arange(len(per)), per), sizes)
        keys, times = _summed(row * self.span + self.pair[at], self.times[at])
        return keys % self.span, times, np.searchsorted(keys, np.arange(len(per) + 1) * self.span)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _parts(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Aligner, pa.RecordBatch, np.ndarray, np.ndarray]]:
    own = aligner(*paths)
    keep_learned("token_alignment", aligner.cache_clear)
    for batch in batches:
        for part in slices(batch, "text", PIECE_BYTES, "token_alignment"):
            yield own, part, *own.rows(part.column("text"))


def _by_row(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    edge = np.concatenate(([0], np.cumsum(values)))
    stop = np.cumsum(per)
    return edge[stop] - edge[stop - per]


def _joined(own: Aligner, units: np.ndarray, per: np.ndarray) -> Iterator[bytes]:
    """The groups of each row as text."""
    each = map(own.groups.__getitem__, units.tolist())
    for k in per.tolist():
        yield b";".join(islice(each, k))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, groups) of every row of ``docs(doc_id, text)``: ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of ids, or empty without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part, units, per in _parts((a_path, b_path), batches):
            texts = pa.array(list(_joined(own, units, per)), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts.cast(pa.string())], names=["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, groups string")


def linked_ids(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row: what is aligned in a text, and each pair of ids linked in it with its links.

    A pair is the A id times the size of B's vocabulary plus the B id.
    """
    counts = ("n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in counts), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part, units, per in _parts((a_path, b_path), batches):
            sha = [hashlib.sha256(t).hexdigest() if k else "" for t, k in zip(_joined(own, units, per), per.tolist(), strict=True)]
            pairs, times, edge = own.links(units, per)
            lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x)) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(_by_row(getattr(own, k)[units], per)) for k in counts), pa.array(sha, pa.string()), *lists], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): documents that hold each pair of ids linked, and whether no pair of its A id is in more."""
    summed = materialise(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")))
    a = F.expr(f"pair div {width}")
    most = summed.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    out = materialise(summed.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    discard(summed)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def _few(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with at most so many pairs, or one row."""
    stop, at = np.cumsum(np.diff(np.asarray(batch.column("pairs").offsets))), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _sent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(pairs in order, their documents, whether best, least documents) of the most frequent pairs, at most ``SENT_PAIRS``.

    They are chosen by powers of two of their documents, so that one small count says
    which; what is collected has a fixed bound.
    """
    power = F.floor(F.log2(F.col("docs"))).cast("int")
    sizes = {r.power: r.n for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    least, room = 1 << 62, SENT_PAIRS
    for k in sorted(sizes, reverse=True):
        if sizes[k] > room:
            break
        room -= sizes[k]
        least = 1 << k
    if room == SENT_PAIRS - sum(sizes.values()):
        least = 1
    got = counts.where(F.col("docs") >= least).toArrow()
    pair = np.asarray(got["pair"])
    order = np.argsort(pair)
    return pair[order], np.asarray(got["docs"])[order], np.asarray(got["best"]).astype(bool)[order], least


def token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs(doc_id, text)``.

    A encodes a space and the text, B the text. ``n_best`` are links whose pair of ids no
    other pair of the A id exceeds in documents, ``count_sum`` the documents of the links'
    pairs. A text that is null, empty or not given back by either tokenizer has no tokens:
    zeros and an empty ``groups_sha256``. Special tokens in a text are ordinary text. A null doc_id
    is kept; repeated rows count each as a document; other columns are ignored; an empty
    table gives no rows; texts of any length are whole.
    """
    linked = materialise(linked_ids(docs, a_path, b_path))
    counts = pair_counts(linked, vocabulary_size(b_path))
    sent_pairs, sent_docs, sent_best, least = _sent(counts)
    sent = docs.sparkSession.sparkContext.broadcast((sent_pairs, sent_docs, sent_best))
    fields = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs_of, best_of = sent.value
        for batch in batches:
            for part in _few(batch):
                lists, each = part.column("pairs"), part.column("times")
                pairs, times, per = np.asarray(lists.flatten()), np.asarray(each.flatten()), np.diff(np.asarray(lists.offsets))
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                here = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                total = np.where(here, docs_of[at], 0) * times if len(known) else 0 * times
                best = np.where(here & best_of[at], times, 0) if len(known) else 0 * times
                edge = np.concatenate(([0], np.cumsum(~here)))[np.concatenate(([0], np.cumsum(per)))].astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x[~here])) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([*map(part.column, fields), pa.array(_by_row(best, per)), pa.array(_by_row(total, per)), *rest], names=[*fields, "n_best", "count_sum", "rest", "times"])

    ddl = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, times array<long>"
    done = linked.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, ddl)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:  # every pair was sent
        discard(counts)
        return done.select(*out)
    done = materialise(done)
    discard(linked)
    rest = done.select("row", F.explode(F.arrays_zip(F.col("rest").alias("pair"), "times")).alias("x")).select("row", "x.pair", "x.times")
    met = rest.join(counts.where(F.col("docs") < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("docs")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    met = done.join(met, "row", "left").na.fill(0, ["more_sum", "more_best"])
    return met.withColumn("n_best", F.col("n_best") + F.col("more_best")).withColumn("count_sum", F.col("count_sum") + F.col("more_sum")).select(*out)
