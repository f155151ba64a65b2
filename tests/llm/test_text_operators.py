"""Operators 3, 5, 6, 7 and 9 against brute force, round trips and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup, textkit
from tidemark.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, n long, removed string, marked string, same string, _c0 int"


def docs(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, 1, "x", "y", "z", 5) for i, t, lang in rows], SCHEMA)


def words(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def edited(rng, text, k):
    parts = text.split(" ")
    for _ in range(k):
        parts[rng.randrange(len(parts))] = f"e{rng.randrange(10**6)}"
    return " ".join(parts)


EDGES = [(None, "null id text one two three", "en"), (1, None, None), (2, "", "en"), (3, " \n\t ", "fr"), (4, "Short text", "en"), (5, "short TEXT", "en"), (5, "short TEXT", "en"), (6, "!!! 123", "en")]


def shingle_sets(rows):
    out = []
    for _, text, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(rows):
    """(doc_id, n_shingles, component_id, n_links) of every row."""
    sets, ids = shingle_sets(rows), [r[0] for r in rows]
    label = {i: i for i in ids if i is not None}
    linked = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(len(rows)):
            if ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                linked[a].add((ids[b], frozenset(sets[b])))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for i, _ in linked[a]:
                low = min(label[ids[a]], label[i])
                if label[ids[a]] != low or label[i] != low:
                    label[ids[a]] = label[i] = low
                    changed = True
    return sorted(((i, len(s), label.get(i), len(x - {(i, frozenset(s))})) for i, s, x in zip(ids, sets, linked, strict=True)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(jaccard_join, "TILE_ROWS", 3)
    rng = random.Random(seed)
    rows = list(EDGES)
    base = [words(rng, rng.choice((8, 30, 60, 150))) for _ in range(12)]
    passage = words(rng, 40)
    n = 100
    for b in base:
        for _ in range(rng.randrange(1, 9)):
            rows.append((n, edited(rng, b, rng.randrange(0, 6)), "en"))
            n += 1
    for _ in range(15):
        rows.append((n, words(rng, 30) + " " + passage, "en"))
        n += 1
    rows += [(n + k, base[2], "en") for k in range(4)] + [(n, base[2], "en")] * 2
    got = jaccard_join.jaccard_join(docs(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=repr) == brute_components(rows)


def test_jaccard_join_of_one_id_with_several_texts(spark):
    rng = random.Random(41)
    one, two, three = (words(rng, 60) for _ in range(3))
    rows = [(1, one, "en"), (2, two, "en"), (3, one, "en"), (3, edited(rng, two, 1), "en"), (4, three, "en"), (4, None, "en"), (5, edited(rng, three, 1), "en"), (6, words(rng, 60), "en"), (6, "!", "en"), (7, edited(rng, one, 1), "en")]
    got = jaccard_join.jaccard_join(docs(spark, rows)).collect()
    want = brute_components(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=repr) == want
    assert {i: c for i, _, c, _ in want} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 1}
    without = jaccard_join.jaccard_join(docs(spark, rows), links=False)
    assert without.columns == ["doc_id", "n_shingles", "component_id"] and without.count() == len(rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(docs(spark, EDGES).limit(0)).count() == 0


def _multiset_similarity(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    return sum((a & b).values()), sum((a | b).values())


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    items = [(k, words(rng, rng.choice((15, 30, 45))), "x") for k in range(12)] + [(90, None, "x"), (91, "", "x"), (92, "three word item", "x")]
    rows = list(EDGES)
    for n in range(80):
        text = words(rng, rng.randrange(5, 80))
        if n % 3 == 0:
            text += " " + edited(rng, items[n % 12][1], rng.randrange(0, 3)) + " " + words(rng, rng.randrange(0, 30))
        rows.append((1000 + n, text, "en"))
    rows.append((3000, "Three  word\nITEM", "en"))
    benchmark = spark.createDataFrame(items, "item_id long, text string, doc_id string")

    def cut(text):
        w = text.lower().split()
        return w, ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])

    want = set()
    for i, text, _ in rows:
        _, hs = cut(text or "")
        for item, body, _ in items:
            iw, its = cut(body or "")
            for start in {p - q for p, h in enumerate(hs) for q, g in enumerate(its) if h == g}:
                window = hs[max(0, start) : start + max(len(iw) - 4, 1)]
                common, union = _multiset_similarity(window, its)
                if 100 * common >= 80 * union:
                    want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs(spark, rows), benchmark).collect()}
    assert got == want and len(want) > 10
    assert decontaminate.contaminations(docs(spark, EDGES).limit(0), benchmark).count() == 0
    kept = decontaminate.decontaminate(docs(spark, rows), benchmark)
    assert kept.count() == len(rows) - len([r for r in rows if r[0] in {d for d, _ in want}])


def test_decontamination_tries_every_start(spark):
    rng = random.Random(17)
    items = [(k, words(rng, 60 if k % 2 else 33)) for k in range(6)]
    rows = []
    for n in range(60):
        w = items[n % 6][1].split(" ")
        at = rng.randrange(25, len(w) - 5) if n % 3 else len(w) // 2
        moved = w[at:] + w[:at] if n % 2 else w[: at - 6] + w[at:] + w[at - 6 : at]
        left, right = rng.choice((0, 20)), rng.choice((0, 20))
        body = [*words(rng, left).split(" ")] * (left > 0) + moved[rng.randrange(3) :] + words(rng, right).split(" ") * (right > 0)
        rows.append((n, " ".join(body), "en"))
    swapped = items[1][1].split(" ")
    rows.append((100, words(rng, 40) + " " + " ".join(swapped[30:] + swapped[:30]) + " " + words(rng, 40), "en"))
    rows.append((101, " ".join(["again"] * 70), "en"))
    items.append((7, " ".join(["again"] * 40)))
    want = {}
    cut = lambda text: [tuple(w[i : i + 5]) for w in [text.split(" ")] for i in range(len(w) - 4)]
    for i, text, _ in rows:
        hs = cut(text)
        for item, body in items:
            its = cut(body)
            for start in range(1 - len(its), len(hs)):
                common, union = _multiset_similarity(hs[max(0, start) : start + len(its)], its)
                if 100 * common >= 80 * union:
                    n, best = want.get((i, item), (0, (0, 0)))
                    want[i, item] = n + 1, max(best, (common / union, -max(start, 0)))
    found = decontaminate.contaminations(docs(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert (100, 1) in want and (101, 7) in want and len(want) > 20
    assert {(r.doc_id, r.item_id): (r.n_windows, (r.similarity, -r.first_word)) for r in found} == want


def test_fingerprints_of_very_long_items(spark):
    one = spark.range(70_000).select(F.lit(1).alias("k"), F.xxhash64(F.lit("shingle")).alias("h"))
    many = decontaminate.fingerprints(one, "k").first().blocks
    assert many == decontaminate.fingerprints(one.limit(1), "k").first().blocks and any(many)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(5)
    odd = ["", "   ", "a" * 5000, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>c", "\n\n  x\t\t", "日本語 テスト 🎉🎉", "I'll don't 123abc !!??", " " * 50 + "x", "ab" * 3000, "x \n y", "é́ ​\x00\x01", "x ", " x"]
    texts = odd + ["".join(rng.choice("ab 'éZ9\n\t.,!日") for _ in range(rng.randrange(200))) for _ in range(200)]
    coder = bpe.Codec(vocabulary_path())
    ids, counts = coder.encode(texts)
    edge = np.concatenate(([0], np.cumsum(counts)))
    for k, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[edge[k] : edge[k + 1]].tolist() == want
        assert coder.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False)
    assert coder.decode(np.array([coder.of_byte[0xC3]])) == "\ufffd"
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, None, None)]
    for r in bpe.bpe_digests(docs(spark, rows), vocabulary_path()).collect():
        text = (texts[r.doc_id] if r.doc_id is not None else "") or ""
        own = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_round_trip(docs(spark, rows).limit(0), vocabulary_path()).count() == 0


def test_bpe_memory_may_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_UNITS", 5)
    coder = bpe.Codec(vocabulary_path())
    one = coder.encode(["some words that fill it up quickly indeed"])[0].tolist()
    coder.encode(["other words"])
    assert coder.encode(["some words that fill it up quickly indeed"])[0].tolist() == one


def test_what_was_learned_goes_when_another_operator_comes():
    batch, gone = pa.RecordBatch.from_pydict({"text": ["some text", None, ""]}), []
    textkit.keep_learned("one", lambda: gone.append("one"))
    assert sum(p.num_rows for p in textkit.slices(batch, "text", 4, "one")) == 3 and not gone
    assert sum(p.num_rows for p in textkit.slices(batch, "text", 4)) == 3 and gone == ["one"]
    assert list(textkit.slices(batch.slice(0, 0), "text")) == [] and gone == ["one"]


def test_line_dedup(spark):
    rng = random.Random(11)
    own = lambda: "\n".join(words(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(2, 9)))
    long_line, several = words(rng, 60), "\n".join(words(rng, 9) for _ in range(8))
    rows = [(1000 + k, f"{own()}\n{long_line if k % 2 else several}\n{own()}", "en") for k in range(20)]
    clean = [(100 + k, own() + "\nAll rights reserved.", "en") for k in range(10)]
    copies = [(2000 + k, several + "\n" + long_line, "en") for k in range(3)]
    given = rows + clean + copies + EDGES
    got = collections.defaultdict(list)
    for r in line_dedup.line_dedup(docs(spark, given).repartition(4), keep=["n", "same"]).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(given)
    for k, text, _ in clean + EDGES:
        assert all(r.text == text and r.removed == 0 for r in got[k])
    assert sum(long_line in r.text for k in range(1000, 1020) for r in got[k]) == 1
    lines = several.split("\n")
    left = sum(line in r.text.split("\n") for k in range(1002, 1020, 2) for r in got[k] for line in lines)
    assert left <= 9 * 2  # at most a line at either end may hide in an unrelated chunk
    for k, text, _ in rows:
        kept = got[k][0].text.split("\n")
        assert kept == [line for line in text.split("\n") if line in set(kept)]
    assert line_dedup.line_dedup(docs(spark, EDGES).limit(0)).count() == 0


def test_line_dedup_removes_passages_of_short_lines(spark):
    rng = random.Random(23)
    rows, passages, firsts = [], {}, {}
    for number, (lines, size) in enumerate([(4, 13), (5, 11), (6, 9), (4, 15), (7, 8), (3, 17), (3, 20)] * 6):
        passage = passages[number] = "\n".join(words(rng, size) for _ in range(lines))
        for k in range(10):
            around = [words(rng, rng.randrange(3, 14)) for _ in range(4)]
            rows.append((1000 * number + k, "\n".join([*around[:2], passage, *around[2:]]), "en"))
            firsts[1000 * number + k] = "\n".join(around)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, rows).repartition(4)).collect()}
    for i, text, _ in rows:
        if i % 1000:
            assert got[i].text == firsts[i] and got[i].removed > 0
        else:
            assert got[i].text == text and got[i].removed == 0


def brute_line_dedup(rows, min_words=30, by_row=False):
    """Distinct rows of (doc_id, text): chunks and pairs by their bytes, first places by doc_id."""
    units = []
    for i, text in sorted(rows):
        data = np.frombuffer((text or "").encode(), np.uint8)
        _, start, end, count, fresh = line_dedup.line_spans(data, np.array([0, len(data)]), line_dedup.WINDOW, line_dedup.ONE_IN, line_dedup.LONG_LINE)
        lines = [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
        edge = [*np.flatnonzero(fresh).tolist(), len(lines)]
        own = [(range(a, b), sum(count[a:b]), "chunk") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        own += [(range(k, k + 2), count[k] + count[k + 1], "pair") for k in range(len(lines) - 1) if min(count[k], count[k + 1]) < line_dedup.LONG_LINE]
        units.append((i, text, lines, count, own))
    seen, out = set(), {}
    for i, text, lines, count, own in units:
        key = (i, text) if by_row else i
        marked = set()
        for places, n, kind in own:
            body = kind, b"".join(lines[k] for k in places).removesuffix(b"\n")
            if n and body in seen:
                marked |= set(places)
            elif n:
                seen.add(body)
        gone, run = set(), []
        for k in [*range(len(lines)), None]:
            if k in marked:
                run.append(k)
            else:
                gone |= set(run) if sum(count[j] for j in run) >= min_words else set()
                run = []
        left = b"".join(line for k, line in enumerate(lines) if k not in gone)
        if gone and len(lines) - 1 in gone and not text.endswith("\n"):
            left = left.removesuffix(b"\n")
        out[key] = left.decode() if gone else text
    return out


@pytest.mark.parametrize("bits", [64, 4])
def test_line_dedup_equals_brute_force(spark, bits):
    rng = random.Random(31)
    pool = [words(rng, rng.choice((0, 2, 9, 12, 15, 16, 20, 40))) for _ in range(60)]
    passages = ["\n".join(rng.sample(pool, k)) for k in (1, 2, 3, 3, 4, 4, 5, 8, 12)]
    rows = []
    for n in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else words(rng, rng.randrange(0, 25)) for _ in range(rng.randrange(1, 8))]
        rows.append((n, "\n".join(parts) + rng.choice(("", "\n", "\n\n"))))
    rows += [(200, None), (201, ""), (202, "\n"), (203, "ß " * 40), (204, "ß " * 40), (205, "é " * 40)]
    want = brute_line_dedup(rows)
    # few bits make different chunks collide: only the comparison of bytes tells them apart
    got = line_dedup.line_dedup(docs(spark, [(i, t, "en") for i, t in rows]).repartition(4), bits=bits)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert sum(want[i] != t for i, t in rows) > 20 and want[205] == "é " * 40 and want[204] != want[203]


def test_language_id(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ba", "bo", "bi", "lu"], "bb": ["tre", "kos", "vun", "dra"], "cc": ["çhe", "ñaz", "éou", "süm"]}
    say = lambda k: " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(40))
    rows = [(n, say(k), k) for n, k in enumerate(rng.choice(list(sounds)) for _ in range(400))]
    got = language_id.identify(docs(spark, rows + EDGES))
    truth = {n: k for n, _, k in rows}
    found = [r for r in got.collect() if r.doc_id in truth and r.doc_id > 6]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 50 and sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.99
    edge = {r.doc_id: r.lang_pred for r in language_id.identify(docs(spark, EDGES)).collect()}
    assert edge[1] == edge[2] == edge[3] == edge[6] == "und"
    nothing = language_id.identify(docs(spark, [(1, "text", None)]))
    assert tuple(nothing.first())[2:] == ("und", 0.0)
    assert language_id.identify(docs(spark, EDGES).limit(0)).count() == 0
    assert set(language_id.identify(docs(spark, rows[:50]), keep=["doc_id", "same", "_c0"]).columns) == {"doc_id", "same", "_c0", "held_out", "lang_pred", "score"}


def test_rare_languages_are_learned(spark):
    rng = random.Random(7)
    say = lambda sounds: " ".join("".join(rng.choice(sounds) for _ in range(3)) for _ in range(30))
    rows = [(n, say(["ba", "bo", "bi", "lu"]), "en") for n in range(300)] + [(1000 + n, say(["tre", "kos", "vun", "dra"]), "xx") for n in range(12)] + [(2000, "çßç ßçß " * 9, None)]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows)).collect()}
    assert all(got[n].lang_pred == lang for n, _, lang in rows if lang) and sum(got[1000 + n].held_out for n in range(12)) > 0
    assert got[2000].lang_pred in ("en", "xx") and got[2000].score == 0.0  # no known gram, yet letters
    few = [(n, t, lang) for n, t, lang in rows if n in (1, 2, 1003)]
    assert [r.lang_pred for r in language_id.identify(docs(spark, few)).orderBy("doc_id").collect()] == ["en", "en", "xx"]


def test_decontamination_among_repeated_words(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(500)]
    around = "a b c d e ".split() * 60
    cases = [around + item[30:477] + around, around + item + around, item[:250] + around[:40] + item[250:], item[:100] * 5]
    short = [w for k in range(20) for w in ("of", "the", f"x{k}", "of", "the")]
    cases += [around[:50] + short + around[:50], around[:30] + short[: len(short) - 9] + around[:30], short + short, [rng.choice(short) for _ in range(300)]]
    found = decontaminate.contaminations(docs(spark, [(k, " ".join(c), "en") for k, c in enumerate(cases)]), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.first_word, round(r.similarity, 9)) for r in found.collect()}
    cut = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    want = {}
    for k, case in enumerate(cases):
        for number, own in ((1, item), (2, short)):
            hs, its, hits = cut(case), cut(own), []
            for start in range(1 - len(its), len(hs)):
                common, union = _multiset_similarity(hs[max(0, start) : start + len(its)], its)
                if 100 * common >= 80 * union:
                    hits.append((-common / union, max(start, 0)))
            if hits:
                want[k, number] = (len(hits), min(hits)[1], round(-min(hits)[0], 9))
    assert set(got) == set(want) and (0, 1) in want
    assert all(got[x][1:] == want[x][1:] for x in want)
    assert all(0.9 * want[x][0] <= got[x][0] <= want[x][0] for x in want)  # some windows at the edge of the similarity lie outside the radius


def test_language_scores_equal_brute_force():
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdé  1\n") for _ in range(rng.randrange(0, 120))) for _ in range(60)] + ["", " ", "é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])

    def grams_of(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
        return [(k, raw[i : i + k]) for k in language_id.ORDERS for i in range(len(raw) - k + 1) if 32 not in raw[i + 1 : i + k - 1]]

    every = sorted({g for t in texts for g in grams_of(t)})
    own = [{g for g in every if rng.random() < 0.5} for _ in range(3)]
    code = lambda g: int.from_bytes(g[1], "big") | g[0] << 56
    model = language_id.build(["x", "y", "z"], [np.array([code(g) for g in s], np.uint64) for s in own], 1 << 22)
    score = model.score(data, offsets)
    for i, text in enumerate(texts):
        hits = np.array([sum(g in s for g in grams_of(text)) for s in own], float)
        want = hits / hits.sum() if hits.sum() else hits
        assert abs(score[i] - want).max() < 0.01


def test_bloom_masks_name_every_language():
    codes = [np.arange(k * 100, k * 100 + 100, dtype=np.uint64) for k in range(70)]
    model = language_id.build([f"l{k:02d}" for k in range(70)], codes, 1 << 16)
    for k in (0, 5, 63, 64, 69):
        mask = model.contain(codes[k])
        assert ((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    assert (model.false_positive < 0.01).all()


def brute_contaminated(text, items):
    cut = lambda t: [tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)]
    hs = cut(text)
    for body in items:
        its = cut(body)
        for start in range(1 - len(its), len(hs)):
            common, union = _multiset_similarity(hs[max(0, start) : start + len(its)], its)
            if common and 100 * common >= 80 * union:
                return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]
    rng = random.Random(19)
    items = [words(rng, 30) for _ in range(3)]
    passage = "\n".join(words(rng, 15) for _ in range(5))
    rows = [(n, words(rng, 60) + (f"\n{passage}\n" if n % 9 == 0 else " ") + words(rng, 20)) for n in range(60)]
    rows += [(100 + n, edited(rng, rows[n][1], 1)) for n in range(1, 9)]
    rows += [(200, words(rng, 20) + " " + items[0] + " " + words(rng, 9)), (201, edited(rng, items[1], 1)), (300, None), (301, ""), (302, "!!! 123"), (None, words(rng, 50)), (3, rows[3][1]), (4, words(rng, 70))]
    rows = [(i, t and "word " * 12 + t) if i != 302 else (i, t) for i, t in rows]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    table.repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    table.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for sub in "ab":
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/{sub}/benchmark.parquet")
    last = 10**6  # stands for null, which sorts last
    left = brute_line_dedup({(last if i is None else i, t) for i, t in rows if t and re.search("[a-z]", t)}, by_row=True)
    ordered = sorted((k for k in left if left[k].strip()), key=lambda k: (k[0], k[1]))
    groups = [c for _, _, c, _ in sorted(brute_components([(n, left[k], "") for n, k in enumerate(ordered)]))]
    kept = [k for n, k in enumerate(ordered) if groups[n] == n]
    library = Tokenizer.from_file(vocabulary_path())
    want = sorted((k[0], len(library.encode(left[k], add_special_tokens=False).ids), hashlib.sha256(left[k].encode()).hexdigest()) for k in kept if not brute_contaminated(left[k], items))
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted((last if r.doc_id is None else r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == want
    ids = [k for k, _, _ in want]
    assert last in ids and ids.count(3) == 1 and ids.count(4) == 2 and not {101, 102, 200, 300, 301, 302} & set(ids)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
