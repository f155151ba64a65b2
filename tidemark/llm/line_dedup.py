"""Operator 7: removal of repeated line chunks.

Lines are grouped into content-defined chunks: rolling hashes over line hashes
choose the boundaries, so an insertion shifts none beyond its neighbourhood.
Chunks whose hash occurs more than once are compared byte for byte, and equal ones are
marked everywhere but at their first place. A passage's edge lines may hide in a chunk
with an unrelated neighbour, and a passage no longer than the window may have no
boundary of its own, so neighbouring lines, of which at least one is short, are compared
in pairs too: they extend a run line by line. Runs of marked lines that are long enough
are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import bitmap_of, buffers, in_bitmap, mix, slices, span_hashes, word_spans
from tidemark.session import discard, materialise

#: Lines under each rolling hash.
WINDOW = 3
#: A boundary hash selects one line in this many, on either side of a line.
ONE_IN = 2
#: A line of at least so many words is a chunk of its own.
LONG_LINE = 16
#: A run of repeated lines goes if it has at least so many words.
MIN_WORDS = 30
#: Words (8 bytes each) of the bitmap of repeated hashes: bodies whose hash is not in it are not sent.
BITMAP_WORDS = 1 << 20

#: Places from here on are pairs of lines, those below are chunks.
_PAIRS = 1 << 30
_SEED_PAIR = np.uint64(0x9E6C63D0876A9A35)
_SEED_AFTER, _SEED_BEFORE = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F)


def _rolling(line_hash: np.ndarray, row: np.ndarray, window: int, seed: np.uint64, forward: bool) -> np.ndarray:
    """A hash over the ``window`` lines of one text that end (or start) at each line."""
    total = line_hash.copy()
    n = len(line_hash)
    for k in range(1, min(window, n)):
        if forward:
            same = row[:-k] == row[k:]
            total[:-k][same] += line_hash[k:][same] * (seed | np.uint64(2 * k + 1))
        else:
            same = row[:-k] == row[k:]
            total[k:][same] += line_hash[:-k][same] * (seed | np.uint64(2 * k + 1))
    return mix(total ^ seed)


def line_spans(data: np.ndarray, offsets: np.ndarray, window: int, one_in: int, long_line: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, words, fresh) of every line; ``fresh`` lines begin a chunk, bytes include the line end."""
    newline = np.flatnonzero(data == 10) + 1
    sizes = np.diff(offsets)
    starts = np.unique(np.concatenate((offsets[:-1][sizes > 0], newline[newline < len(data)])))
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool)
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.concatenate((starts[1:], [len(data)])), offsets[row + 1])
    bare = ends - (data[ends - 1] == 10)
    word_start, _, _ = word_spans(data, offsets)
    words = np.searchsorted(word_start, ends) - np.searchsorted(word_start, starts)
    line = span_hashes(data, starts, bare)
    after = _rolling(line, row, window, _SEED_AFTER, False) % np.uint64(one_in) == 0
    before = _rolling(line, row, window, _SEED_BEFORE, True) % np.uint64(one_in) == 0
    long = words >= long_line
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (row[1:] != row[:-1]) | after[:-1] | before[1:] | long[:-1] | long[1:]
    return row, starts, ends, words, fresh


def _chunks_of(row: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, words) of every chunk of the lines."""
    if not len(starts):
        return row, starts, ends, words
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return row[first], starts[first], ends[last], np.add.reduceat(words, first)


def chunk_spans(data: np.ndarray, offsets: np.ndarray, window: int, one_in: int, long_line: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, words) of every chunk; a chunk's bytes include its line ends."""
    return _chunks_of(*line_spans(data, offsets, window, one_in, long_line))


def _content(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where a chunk ends without its last line end."""
    return end - (data[end - 1] == 10)


def _chunks(window: int, one_in: int, long_line: int, bits: int, wanted=None):
    """(key, doc_id, same, place, words) of every chunk and pair; with the bitmap ``wanted`` of those in it, and their bytes."""
    with_text = wanted is not None
    mask = np.uint64((1 << bits) - 1)
    fields = [("key", pa.int64()), ("doc_id", pa.int64()), ("same", pa.int64()), ("place", pa.int32()), ("words", pa.int32())]
    schema = pa.schema([*fields, ("body", pa.binary())] if with_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                lines = line_spans(data, offsets, window, one_in, long_line)
                row, start, end, words = _chunks_of(*lines)
                line_row, line_start, line_end, line_words, _ = lines
                # two long neighbours are chunks of their own already
                two = np.flatnonzero((line_row[1:] == line_row[:-1]) & ((line_words[1:] < long_line) | (line_words[:-1] < long_line)))
                pair_stop = _content(data, line_end[two + 1])
                key = np.concatenate((span_hashes(data, start, _content(data, end)), mix(span_hashes(data, line_start[two], pair_stop) ^ _SEED_PAIR)))
                place = np.concatenate((np.arange(len(row)) - np.searchsorted(row, row), _PAIRS + two - np.searchsorted(line_row, line_row[two])))
                key &= mask
                row, start, stop = np.concatenate((row, line_row[two])), np.concatenate((start, line_start[two])), np.concatenate((_content(data, end), pair_stop))
                words = np.concatenate((words, line_words[two] + line_words[two + 1]))
                if with_text:
                    sent = in_bitmap(wanted.value, key) & (words > 0)
                    key, place, row, start, stop, words = (x[sent] for x in (key, place, row, start, stop, words))
                take = pa.array(row)
                out = [pa.array(key.view(np.int64)), part.column("doc_id").take(take), part.column("same").take(take), pa.array(place.astype(np.int32)), pa.array(words.astype(np.int32))]
                if with_text:
                    raw = data.tobytes()
                    out.append(pa.array([raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def _cut(window: int, one_in: int, long_line: int, min_words: int):
    def clean(text: str, marked: list[int]) -> tuple[str, int]:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        _, start, end, words, fresh = line_spans(data, np.array([0, len(data)]), window, one_in, long_line)
        chunk, places = np.cumsum(fresh) - 1, np.asarray(marked)
        hit = np.isin(chunk, places[places < _PAIRS])
        first = places[places >= _PAIRS] - _PAIRS
        hit[first] = hit[first + 1] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        keep = np.ones(len(start), bool)
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if words[a:b].sum() >= min_words:
                keep[a:b] = False
        if keep.all():
            return text, 0
        left = b"".join(raw[a:b] for a, b, k in zip(start.tolist(), end.tolist(), keep, strict=True) if k)
        if not keep[-1] and left.endswith(b"\n") and not raw.endswith(b"\n"):
            left = left[:-1]
        return left.decode(), len(np.unique(chunk[~keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, counts = [], []
                for text, marked in zip(part.column("text").to_pylist(), part.column("marked").to_pylist(), strict=True):
                    text, k = clean(text, marked) if marked and text else (text, 0)
                    texts.append(text)
                    counts.append(k)
                rest = [n for n in part.schema.names if n not in ("text", "marked")]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[*rest, "text", "removed"])

    return run


def line_dedup(docs: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, long_line: int = LONG_LINE, min_words: int = MIN_WORDS, keep: list[str] | None = None, bits: int = 64) -> DataFrame:
    """(doc_id, text, removed) of every row of ``docs(doc_id, text)``: its text without repeated runs.

    ``keep`` names further columns of ``docs`` to return as they are.

    Of equal chunks, and of equal pairs of lines, the first by (doc_id, text hash, place)
    stays; nulls sort last. A run of lines in later occurrences is removed if it has
    ``min_words`` words. The first occurrence of a line is in no later one, so it stays.

    * null text stays null, an empty one empty; ``removed`` counts chunks that lost a
      line (0 there);
    * rows equal in doc_id and text are one document: all keep or lose the same;
      rows that share only the doc_id are different documents;
    * a null doc_id takes part like any other; other columns are ignored;
    * lines end at ``\\n``; a text of any length is whole; an empty table gives no rows.

    Per repeated key only a minimum is gathered, combined before the shuffle, and
    the joins on keys are ones that Spark splits when a key is hot. Bytes are sent only
    for hashes (of ``bits`` bits) that repeat; equal hashes of different bytes are told
    apart.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))
    fields = "key long, doc_id long, same long, place int, words int"
    where = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "same", "place")
    light = rows.mapInArrow(_chunks(window, one_in, long_line, bits), fields)
    repeated = light.where("words > 0").groupBy("key").agg(F.min(where).alias("first"), F.max(where).alias("other")).where("first <> other").select("key")
    repeated = materialise(repeated)
    wanted = bitmap_of(repeated, "key", BITMAP_WORDS)
    heavy = rows.mapInArrow(_chunks(window, one_in, long_line, bits, wanted), fields + ", body binary")
    held = materialise(heavy.join(repeated, "key").select("key", "body", "doc_id", "same", "place"))
    wanted.destroy()
    pair = F.col("place") >= _PAIRS
    firsts = held.groupBy("key", F.col("body").alias("model"), pair.alias("of_pair")).agg(F.min(where).alias("first"))
    later = held.join(firsts, "key").where((F.col("body") == F.col("model")) & (pair == F.col("of_pair")) & (where != F.col("first")))
    marks = later.groupBy("doc_id", "same").agg(F.collect_set("place").alias("marked"))
    marks = materialise(marks)
    carried = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or ())]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"), *carried)
    joined = whole.join(marks.withColumnRenamed("doc_id", "d").withColumnRenamed("same", "s"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s")), "left")
    kept = [f"_k{i}" for i in range(len(carried))]
    ready = joined.select("doc_id", *kept, "text", F.coalesce("marked", F.array().cast("array<int>")).alias("marked"))
    schema = ready.drop("text", "marked").withColumns({"text": F.lit(None).cast("string"), "removed": F.lit(None).cast("int")}).schema
    out = ready.mapInArrow(_cut(window, one_in, long_line, min_words), schema)
    discard(repeated, held)
    return out.select("doc_id", *[F.col(k).alias(c) for k, c in zip(kept, keep or (), strict=True)], "text", "removed")
