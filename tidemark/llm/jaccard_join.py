"""Operator 3: exact n-gram Jaccard join by set-relation skipping.

Sets are distinct word shingles. Equal sets are folded into one class before any
pair is looked at. Classes meet in a prefix index whose lists are cut into blocks
by set size and token position, so that whole blocks which cannot reach the
threshold are skipped (index-level skipping). Every set is first compared with
its lists' leading set only; with those answers at hand, pairs inside one
component, and pairs that the triangle inequality of the Jaccard distance rules
out, are never formed (answer-level skipping). What remains is verified exactly.
Links inside a component are counted incrementally: each set is kept as its
difference from the component's most linked set, and the overlap of two sets follows
from that set's size and their short differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.textkit import bitmap_of, buffers, in_bitmap, mix, shingles, slices
from tidemark.session import discard, materialise

PERCENT = 80
WIDTH = 5
WINDOW_TOKENS = 1_000_000
#: Tokens (16 bytes each) whose frequency orders the index, and the least count worth knowing.
MAX_ORDERED = 1_000_000
LEAST_COUNT = 4
BITMAP_WORDS = 1 << 20
#: Ids (8 bytes each) up to which a list of documents is broadcast to the scan of their texts.
BROADCAST_IDS = 1_000_000
#: Classes, and items of their differences, in a tile of a component.
TILE_ROWS, TILE_ITEMS = 1024, 1_000_000
POSTING = "token long, doc long, same long, n int, pos int"


def _sets_of(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, value = shingles(*buffers(part.column("text")), width)
    return row, value, np.bincount(row, minlength=part.num_rows).astype(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for part in slices(batch, "text"):
        yield part.column("doc_id"), part.column("same"), *_sets_of(part, width)


def _signature(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return _sum_by_row(row, mix(value ^ np.uint64(0x5851F42D4C957F2D)), n).view(np.int64)


def _sum_by_row(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[first]] = np.add.reduceat(value, first)
    return out


def _describe(width: int):
    """Per document: size and set signature; per task: tokens that keep returning."""
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("token", pa.int64()), ("times", pa.int64())])

    def rows(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([(v if isinstance(v := given[f.name], pa.Array) else pa.array(v, f.type)) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        token, times = np.unique(np.concatenate(held), return_counts=True)
        keep = times >= 2
        return rows(token=token[keep].view(np.int64), times=times[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for ids, same, row, value, size in _sets(batch, width):
                sig2 = _sum_by_row(row, mix(value ^ np.uint64(0x14057B7EF767814F)), len(ids))
                yield rows(doc_id=ids, same=same, n=size, sig1=_signature(row, value, len(ids)), sig2=sig2.view(np.int64))
                held.append(value)
                count += len(value)
                if count >= WINDOW_TOKENS:
                    yield frequent(held)
                    held, count = [], 0
        if held:
            yield frequent(held)

    return run


def _prefixes(width: int, percent: int, heavy, common, wanted):
    """Per text the tokens of its prefix, rare ones first: (token, doc, text hash, size, position).

    ``heavy`` broadcasts (tokens, counts), sorted by token, and ``common`` a bitmap of
    tokens known to return: both order the tokens. ``wanted`` is a bitmap of the tokens
    worth a posting; without it only the tokens are given.
    """
    schema = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("same", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = heavy.value
        for batch in batches:
            for ids, same, row, value, size in _sets(batch, width):
                if not len(value):
                    continue
                rank = in_bitmap(common.value, value).astype(np.int64) if common is not None else np.zeros(len(value), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, value), len(tokens) - 1)
                    rank += np.where(tokens[at] == value, counts[at], 0)
                # the values of a row ascend already, so a stable sort by rank is enough
                value = value[np.argsort(row * (int(rank.max()) + 1) + rank, kind="stable")]
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
                pos = np.arange(len(value)) - first[row]
                need = -(-percent * size // 100)
                take = (pos < (size - need + 1)[row]) & _first_of_equals(row, value, size)[row]
                if wanted is not None:
                    take &= in_bitmap(wanted.value, value)
                if wanted is None:  # only counted: the tokens are enough
                    yield pa.RecordBatch.from_arrays([pa.array(value[take].view(np.int64))], ["token"])
                    continue
                own, value, pos = row[take], value[take], pos[take]
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), ids.take(at), same.take(at), pa.array(size[own].astype(np.int32)), pa.array(pos.astype(np.int32))], schema=schema)

    return run


def _least(often: DataFrame, most: int) -> int:
    """The least count that leaves at most ``most`` tokens; counts are gathered by powers of two."""
    steps = {r.step: r.n for r in often.groupBy(F.floor(F.log2("times")).alias("step")).agg(F.count("*").alias("n")).collect()}
    total = 0
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > most:
            return 2 ** (step + 1)
    return LEAST_COUNT


def _first_of_equals(row: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each document is the first in this slice with its set; copies need no prefix of their own."""
    total = np.stack((_sum_by_row(row, mix(value), len(size)), size.astype(np.uint64)), 1)
    keep = np.zeros(len(size), bool)
    keep[np.unique(total, axis=0, return_index=True)[1]] = True
    return keep


def _repeated(texts: DataFrame, width: int, percent: int, heavy, common):
    """A broadcast bitmap of the tokens that stand in the prefixes of two documents or more."""
    counted = texts.mapInArrow(_prefixes(width, percent, heavy, common, None), "token long").groupBy("token").count().where("count > 1")
    return bitmap_of(counted, "token", BITMAP_WORDS)


def _set_rows(width: int):
    schema = pa.schema([("doc", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, value, size = _sets_of(part, width)
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64)))], schema=schema)

    return run


def _reachable(percent: int, x: str, y: str):
    """Whether sets of sizes x.n, y.n with first common token at x.pos, y.pos can link."""
    n, m, p, q = (F.col(c).cast("long") for c in (f"{x}n", f"{y}n", f"{x}pos", f"{y}pos"))
    overlap = F.least(n - p, m - q)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * overlap >= percent * (n + m))


def _sets_by_class(texts: DataFrame, wanted: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(doc, items), materialised: the set of each class in ``wanted(doc)``, from one of its texts with the smallest doc_id."""
    ids = wanted.join(classes.select(F.col("cls").alias("doc"), "rep", "text_of"), "doc").select(F.col("doc").alias("cls"), F.col("rep").alias("doc_id"), F.col("text_of").alias("same"))
    n = wanted.count()
    sets = texts.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, ["doc_id", "same"]).select("cls", "text")
    sets = materialise(sets.mapInArrow(_set_rows(width), "doc long, items array<long>"))
    if sets.count() > n:  # repeated rows
        return _done(sets.dropDuplicates(["doc"]), sets)
    return sets


def _verify(texts: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(x, y, distance, linked) by exact intersection of the two sets."""
    sets = _sets_by_class(texts, pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct(), classes, width)
    both = pairs.join(sets.select(F.col("doc").alias("x"), F.col("items").alias("xs")), "x").join(sets.select(F.col("doc").alias("y"), F.col("items").alias("ys")), "y")
    common = F.size(F.array_intersect("xs", "ys")).cast("long")
    union = F.size("xs") + F.size("ys") - common
    return _done(both.select("x", "y", (1 - common / union).alias("distance"), (100 * common >= percent * union).alias("linked")), sets)


def _done(result: DataFrame, *held: DataFrame) -> DataFrame:
    out = materialise(result)
    discard(*held)
    return out


def jaccard_join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, max_ordered: int = MAX_ORDERED, links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs(doc_id, text)``.

    Two documents link when ``100 * intersection >= percent * union`` of their
    shingle sets; ``component_id`` is the smallest doc_id reachable by links, and
    ``n_links`` counts the other documents whose text links with the row's text. Without
    ``links`` that column, and the comparisons inside components that it needs, are left out.

    * null or wordless text: n_shingles 0, component_id its own doc_id unless another
      text of that doc_id links, no links;
    * null doc_id: the row is returned with a null component_id and links to nothing;
    * repeated rows: each is returned; rows that share a doc_id are one node, which
      links if any of its texts does; ``n_links`` counts a doc_id once for each of its
      texts that links;
    * other columns, whatever their names, are ignored; an empty table gives no rows.

    Tokens are 64-bit hashes. The list of frequent tokens that orders the index holds
    ``max_ordered`` at most, the bitmap of repeated tokens ``BITMAP_WORDS`` words;
    both only save work and drop no candidate.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    described = materialise(texts.mapInArrow(_describe(width), "doc_id long, same long, n long, sig1 long, sig2 long, token long, times long"))
    members = described.where("n is not null").select("doc_id", "same", "n", "sig1", "sig2")
    often = materialise(described.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST_COUNT))
    top = often.where(F.col("times") >= _least(often, max_ordered)).toArrow()
    token = np.asarray(top["token"]).view(np.uint64)
    order = np.argsort(token)
    heavy = sc.broadcast((token[order], np.asarray(top["times"])[order]))

    # a class is one set; from here on sets are named by the number of their class
    known = members.where("n > 0 and doc_id is not null").distinct()
    by_doc = known.groupBy("n", "sig1", "sig2", "doc_id").agg(F.min("same").alias("same"))
    first = F.min(F.struct("doc_id", "same"))
    classes = by_doc.groupBy("n", "sig1", "sig2").agg(first.alias("first"), F.count("*").alias("copies")).withColumn("cls", F.monotonically_increasing_id())
    classes = materialise(classes.select("n", "sig1", "sig2", "cls", "copies", F.col("first.doc_id").alias("rep"), F.col("first.same").alias("text_of")))
    owned = materialise(known.join(classes, ["n", "sig1", "sig2"]).select("doc_id", "same", "cls"))
    usable = texts.where("doc_id is not null")

    # tokens found to return go behind the others, which leaves few of them in the second prefixes
    common = _repeated(usable, width, percent, heavy, None)
    wanted = _repeated(usable, width, percent, heavy, common)
    raw = usable.mapInArrow(_prefixes(width, percent, heavy, common, wanted), POSTING)
    postings = materialise(raw.join(owned.withColumnRenamed("doc_id", "doc"), ["doc", "same"]).select("token", F.col("cls").alias("doc"), "n", "pos").groupBy("token", "doc", "n").agg(F.min("pos").alias("pos")))

    for held in (heavy, common, wanted):
        held.destroy()

    # each set against the most central set of its lists
    leads = postings.groupBy("token").agg(F.min(F.struct("pos", "n", "doc")).alias("lead"), F.count("*").alias("k")).where("k > 1").select("token", F.col("lead.doc").alias("ydoc"), F.col("lead.n").alias("yn"), F.col("lead.pos").alias("ypos"))
    mine = postings.select("token", F.col("doc").alias("xdoc"), F.col("n").alias("xn"), F.col("pos").alias("xpos"))
    led = mine.join(leads, "token").where((F.col("xdoc") != F.col("ydoc")) & _reachable(percent, "x", "y"))
    first_pairs = materialise(led.select(F.least("xdoc", "ydoc").alias("x"), F.greatest("xdoc", "ydoc").alias("y")).distinct())
    answers = _verify(texts, first_pairs, classes, width, percent)
    verified = answers.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # the texts of one doc_id are one node
    several = owned.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    shared = owned.join(several.select("doc_id", "a"), "doc_id").where("cls <> a").select("a", F.col("cls").alias("b"))
    edges = verified.unionByName(shared)
    found = materialise(components(edges))

    rest_pairs = _remaining(postings, found, answers, percent)
    more = _verify(texts, rest_pairs, classes, width, percent).where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    again = bool(more.take(1))
    final = materialise(components(edges.unionByName(more))) if again else found

    placed = classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", "copies", F.coalesce("component", "cls").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = placed.join(smallest, "component")
    out = members.join(owned, ["doc_id", "same"], "left")
    # a wordless row goes by another text of its doc_id
    by_id = owned.join(facts, "cls").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = out.join(by_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    if links:
        counts = _link_counts(texts, placed, verified.unionByName(more), classes, width, percent)
        linked = classes.join(counts, "cls", "left").select("cls", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        out = out.join(linked, "cls", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = materialise(out.select(*columns))
    discard(described, often, classes, owned, postings, first_pairs, answers, found, final, rest_pairs)
    return out


def _link_counts(texts: DataFrame, placed: DataFrame, links: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(cls, linked): how many documents of other classes link with each class that has any.

    The verified links suffice in a component of two classes. In a larger one every
    class is reduced to what its set lacks and adds against the set of its most linked
    class; classes are dealt into tiles of bounded size, and each pair of tiles is one
    group, which counts links from those differences. Rows grow with the classes
    times the tiles, comparisons with the square of the classes of one component.
    """
    size = placed.groupBy("component").agg(F.count("*").alias("k"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    where = placed.select("cls", "component", "copies").join(size, "component")
    ends = both.join(where.select(F.col("cls").alias("a"), "component", "k"), "a")
    two = ends.where("k = 2").join(placed.select(F.col("cls").alias("b"), "copies"), "b").select(F.col("a").alias("cls"), F.col("copies").alias("linked"))
    degree = ends.where("k > 2").groupBy("component", "a").agg(F.count("*").alias("degree"))
    centre = degree.groupBy("component").agg(F.max(F.struct("degree", (-F.col("a")).alias("back"))).alias("top")).select("component", (-F.col("top.back")).alias("centre"))
    grouped = materialise(where.where("k > 2").join(centre, "component").select("cls", "component", "copies", "k", "centre"))
    if not grouped.take(1):
        discard(grouped)
        return two
    sets = _sets_by_class(texts, grouped.select(F.col("cls").alias("doc")), classes, width)
    own = grouped.join(sets.withColumnRenamed("doc", "cls"), "cls")
    middle = sets.select(F.col("doc").alias("centre"), F.col("items").alias("middle"))
    differ = own.join(middle, "centre").select("component", "cls", "copies", F.size("items").alias("n"), F.size("middle").alias("m"), F.array_except("items", "middle").alias("adds"), F.array_except("middle", "items").alias("lacks"))
    differ = _done(differ, sets)
    tiles = differ.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum(F.size("adds") + F.size("lacks")) / TILE_ITEMS)).cast("int").alias("tiles"))
    dealt = differ.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("component", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "cls", "copies", "n", "m", "adds", "lacks")
    counted = met.groupBy("component", "ta", "tb").applyInArrow(_count_links(percent), "cls long, linked long")
    return _done(counted.groupBy("cls").agg(F.sum("linked").alias("linked")).unionByName(two), grouped, differ)


def _count_links(percent: int):
    schema = pa.schema([("cls", pa.int64()), ("linked", pa.int64())])

    def shared(rows: pa.Table, column: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(a, b): how many items the lists of two rows share."""
        lists = rows[column].combine_chunks()
        item = np.asarray(lists.flatten())
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        out = np.zeros((len(a), len(b)), np.float32)
        if not len(item):
            return out
        _, item, times = np.unique(item, return_inverse=True, return_counts=True)
        row, item = row[times[item] > 1], item[times[item] > 1]
        place = np.full((2, len(lists)), -1)
        place[0, a], place[1, b] = np.arange(len(a)), np.arange(len(b))
        _, item = np.unique(item, return_inverse=True)
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        for low in range(0, int(item[-1]) + 1 if len(item) else 0, 2048):
            i, j = np.searchsorted(item, (low, low + 2048))
            block = np.zeros((len(lists), 2048), np.float32)
            block[row[i:j], item[i:j] - low] = 1
            out += block[a] @ block[b].T
        return out

    def run(rows: pa.Table) -> pa.Table:
        tile, cls = np.asarray(rows["tile"]), np.asarray(rows["cls"])
        ta, tb = rows["ta"][0].as_py(), rows["tb"][0].as_py()
        a, b = np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)
        n, copies, m = (np.asarray(rows[c]).astype(np.int64) for c in ("n", "copies", "m"))
        lack = np.asarray(pc.list_value_length(rows["lacks"])).astype(np.int64)
        common = m[0] - lack[a][:, None] - lack[b] + np.rint(shared(rows, "lacks", a, b) + shared(rows, "adds", a, b)).astype(np.int64)
        linked = (100 * common >= percent * (n[a][:, None] + n[b] - common)) & (cls[a][:, None] != cls[b])
        got = [(cls[a], linked @ copies[b])]
        if ta != tb:
            got.append((cls[b], copies[a] @ linked))
        return pa.table([pa.array(np.concatenate([x for x, _ in got])), pa.array(np.concatenate([y for _, y in got]).astype(np.int64))], schema=schema)

    return run


def _remaining(postings: DataFrame, found: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components, by blocks of size and position; materialised."""
    near = answers.select(F.explode(F.array(F.struct(F.col("x").alias("doc"), F.col("y").alias("pivot"), "distance"), F.struct(F.col("y").alias("doc"), F.col("x").alias("pivot"), "distance"))).alias("e")).select("e.*")
    near = near.groupBy("doc").agg(F.min(F.struct("distance", "pivot")).alias("near")).select("doc", F.col("near.pivot").alias("pivot"), F.col("near.distance").alias("far"))
    known = postings.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")).join(near, "doc", "left")
    mixed = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    entries = known.join(mixed, "token", "left_semi").withColumn("band", band).withColumn("step", F.floor(F.log2(F.col("pos") + 1.0)))
    entries = materialise(entries)
    blocks = entries.groupBy("token", "band", "step").agg(F.max("n").alias("n"), F.min("pos").alias("pos"), F.min("n").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    a = blocks.select("token", *(F.col(c).alias(f"a_{c}") for c in ("band", "step", "n", "pos", "least", "lo", "hi")))
    b = blocks.select("token", *(F.col(c).alias(f"b_{c}") for c in ("band", "step", "n", "pos", "least", "lo", "hi")))
    fits = (F.col("b_band") - F.col("a_band")).isin(0, 1) & ((F.col("a_band") < F.col("b_band")) | (F.col("a_step") <= F.col("b_step")))
    fits &= (100 + percent) * F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= percent * (F.col("a_least") + F.col("b_least"))
    fits &= F.least("a_lo", "b_lo") != F.greatest("a_hi", "b_hi")
    kept = a.join(b, "token").where(fits).select("token", "a_band", "a_step", "b_band", "b_step")
    x = entries.select("token", F.col("band").alias("a_band"), F.col("step").alias("a_step"), *(F.col(c).alias(f"x{c}") for c in ("doc", "n", "pos", "component", "pivot", "far")))
    y = entries.select("token", F.col("band").alias("b_band"), F.col("step").alias("b_step"), *(F.col(c).alias(f"y{c}") for c in ("doc", "n", "pos", "component", "pivot", "far")))
    pairs = x.join(kept, ["token", "a_band", "a_step"]).join(y, ["token", "b_band", "b_step"])
    apart = (F.col("xpivot") == F.col("ypivot")) & (F.abs(F.col("xfar") - F.col("yfar")) > 1 - percent / 100 + 1e-9)
    pairs = pairs.where((F.col("xcomponent") != F.col("ycomponent")) & _reachable(percent, "x", "y") & ~F.coalesce(apart, F.lit(False)))
    pairs = pairs.select(F.least("xdoc", "ydoc").alias("x"), F.greatest("xdoc", "ydoc").alias("y")).distinct()
    return _done(pairs.join(answers.select("x", "y"), ["x", "y"], "left_anti"), entries)
