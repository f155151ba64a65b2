"""Operator 9: language identification with bit-sliced Bloom filters over n-grams.

One table of language bitmasks serves all languages: a gram's slots are read once
and their AND is the set of languages that (probably) contain it. Per text and
language the set bits are counted, each count is corrected for that language's
false-positive rate, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import LOWER, buffers, mix, slices
from tidemark.session import discard, materialise

ORDERS = (3, 5)
#: Labelled rows that a model is fitted on at most, the same number of each language.
MAX_FIT_DOCS = 20_000
#: A gram counts for a language from this share of the language's grams on, so a small language keeps all.
LEAST_SHARE = 2e-7
#: Slots at least; beyond it the filter has ``SLOTS_EACH`` for each gram of the largest language.
SLOTS = 1 << 18
SLOTS_EACH = 13
HASHES = 2
#: A language keeps a gram unless another one uses it this many times as often.
RIVAL = 2.5
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[128:] = False
_ANY_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each byte n-gram of letters, a word's edge counting as one place."""
    folded = np.where(_LETTER[data], LOWER[data], 32).astype(np.uint64)
    count = len(folded) - order + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = np.zeros(count, np.uint64)
    for k in range(order):
        code = (code << np.uint64(8)) | folded[k : k + count]
    letter = folded != 32
    valid = np.ones(count, bool)
    for k in range(1, order - 1):
        valid &= letter[k : k + count]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid &= row[:count] == row[order - 1 :]
    return row[:count][valid], code[valid] | np.uint64(order << 56)


@dataclass(frozen=True)
class Model:
    """Languages, the masks of all slots, and each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    false_positive: np.ndarray

    def slots(self, code: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(code)
        for k in range(HASHES):
            yield ((h >> np.uint64(32 * k)) & np.uint64(len(self.masks) - 1)).astype(np.int64)

    def contain(self, code: np.ndarray) -> np.ndarray:
        """(gram, word of 64 languages): the languages that hold each gram."""
        first, *others = self.slots(code)
        out = self.masks[first]
        for at in others:
            out &= self.masks[at]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(row, language): shares of the corrected popcounts, 0 where nothing is known."""
        n, languages = len(offsets) - 1, len(self.languages)
        hits, total = np.zeros((n, languages)), np.zeros(n)
        for order in ORDERS:
            row, code = grams(data, offsets, order)
            if not len(row):
                continue
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            rows = row[first]
            total[rows] += np.diff(np.concatenate((first, [len(row)])))
            mask = self.contain(code)
            for k in range(languages):
                bit = ((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int32)
                hits[rows, k] += np.add.reduceat(bit, first)
        corrected = np.clip((hits - total[:, None] * self.false_positive) / (1 - self.false_positive), 0, None)
        whole = corrected.sum(1, keepdims=True)
        return np.divide(corrected, whole, out=np.zeros_like(corrected), where=whole > 0)


def build(languages: list[str], codes: list[np.ndarray], slots: int = SLOTS) -> Model:
    """A model whose language ``k`` contains the grams ``codes[k]``; the slots grow with them, a power of two."""
    slots = max(slots, 1 << (SLOTS_EACH * max(map(len, codes), default=1) - 1).bit_length())
    masks = np.zeros((slots, (len(languages) + 63) // 64), np.uint64)
    model = Model(languages, masks, np.zeros(len(languages)))
    for k, code in enumerate(codes):
        for at in model.slots(code):
            masks[at, k // 64] |= np.uint64(1 << (k % 64))
    filled = [float(((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))]
    return Model(languages, masks, np.minimum(np.array(filled) ** HASHES, 0.99))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("times", pa.int64())])
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = buffers(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)
            for order in ORDERS:
                row, code = grams(data, offsets, order)
                for lang in dict.fromkeys(langs):
                    gram, times = np.unique(code[(langs == lang)[row]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(times)], schema=schema)


def fit(labelled: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> Model:
    """A model from ``labelled(key, text, lang)``, fitted on at most about ``max_fit_docs`` of its rows.

    Each language has the same number of them at most, taken by a hash of ``key``, so that a rare
    language keeps all of its rows beside frequent ones. What reaches the driver is the
    grams of that bounded sample that make up ``LEAST_SHARE`` of their language.
    """
    usable = labelled.where("text is not null and lang is not null")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("_n"))  # a row for each language
    sizes = sizes.withColumn("_share", F.lit(float(max_fit_docs)) / F.greatest(F.lit(sizes.count()), F.lit(1)) / F.col("_n"))
    sample = usable.join(F.broadcast(sizes), "lang").where((F.col("_share") >= 1) | (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.col("_share") * 1_000_000)).select("text", "lang")
    counts = materialise(sample.mapInArrow(_count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times")))
    totals = counts.groupBy("lang").agg((F.sum("times") * LEAST_SHARE).alias("least"))
    found = counts.join(F.broadcast(totals), "lang").where(F.col("times") >= F.col("least")).select("lang", "gram", "times").toArrow()
    discard(counts)
    names = np.array(found["lang"].to_pylist(), object)
    languages = sorted(set(names.tolist()))
    gram, times = np.asarray(found["gram"]).view(np.uint64), np.asarray(found["times"]).astype(float)
    universe, place = np.unique(gram, return_inverse=True)
    share_of = np.zeros((len(languages), len(universe)))
    for k, lang in enumerate(languages):
        own = names == lang
        share_of[k, place[own]] = times[own] / times[own].sum()
    best = share_of.max(0) if languages else np.zeros(0)
    chosen = []
    for k in range(len(languages)):
        chosen.append(universe[(share_of[k] > 0) & (share_of[k] * RIVAL >= best)])
    return build(languages, chosen)


def _predict(model, drop: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "_text"):
                langs, top = predict_batch(m, part.column("_text"))
                rest = [n for n in part.schema.names if n not in drop]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.array(langs, pa.string()), pa.array(top)], names=[*rest, "_pred", "_score"])

    return run


def predict_batch(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and its score for each text of an Arrow column."""
    data, offsets = buffers(column)
    known = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    lettered = known[offsets[1:]] > known[offsets[:-1]]
    for i in np.flatnonzero(~lettered):
        lettered[i] = bool(_ANY_LETTER.search(column[int(i)].as_py() or ""))
    if not model.languages:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    score = model.score(data, offsets)
    best = score.argmax(1)
    top = np.where(lettered, score[np.arange(len(best)), best], 0.0)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], top


def identify(docs: DataFrame, max_fit_docs: int = MAX_FIT_DOCS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs(doc_id, text, lang)``.

    ``keep`` names columns of ``docs`` to return in front of the prediction instead of doc_id.

    Learns from the texts and non-null languages of the rows whose
    ``crc32(doc_id) mod 5`` is not 0; ``held_out`` says that it is 0 (false for a
    null doc_id, from which nothing is learned). ``und`` with score 0 goes to a null
    text and to one without a letter; a text of unseen grams gets the first
    language, score 0. Whole texts are read, repeated rows are judged each, other
    columns are ignored, and with nothing to learn from every text is ``und``.
    """
    doc_id = F.col("doc_id").cast("long")
    rest = F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))
    base = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), rest.alias("rest"))
    model = fit(base.where("rest <> 0").select(F.col("doc_id").alias("key"), "text", "lang"), max_fit_docs)
    names = ["doc_id"] if keep is None else list(keep)
    held = F.coalesce(rest == 0, F.lit(False))
    # a kept text goes to the workers and back under the name they read, not twice
    place = {c: "_text" if c == "text" and dict(docs.dtypes)[c] == "string" else f"_c{i}" for i, c in enumerate(names)}
    others = [F.col(c).alias(p) for c, p in place.items() if p != "_text"]
    rows = docs.select(*others, held.alias("_held"), F.col("text").cast("string").alias("_text"))
    if keep is None:
        rows = rows.withColumn("_c0", F.col("_c0").cast("long"))
    drop = () if "_text" in place.values() else ("_text",)
    schema = rows.drop(*drop).withColumns({"_pred": F.lit(None).cast("string"), "_score": F.lit(None).cast("double")}).schema
    out = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), drop), schema)
    columns = [F.col(p).alias(c) for c, p in place.items()]
    return out.select(*columns, F.col("_held").alias("held_out"), F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"))
