"""Operators 1, 2, 4, 8 and 10."""

import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import license_scan, queries, secret_scan, toxicity, url_rules, vector_search


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    n, width = 3000, 6
    x = rng.random((n, width)) < 0.3
    linear = x @ np.array([3.0, 2.0, -2.0, 0, 0, 0])
    grade = (linear + rng.logistic(size=n) > 1).astype(int) + (linear + rng.logistic(size=n) > 3)
    row, place = np.nonzero(x)
    w, cut = toxicity.solve(row, place, np.minimum(grade, 2), width, rounds=400)
    assert w[0] > w[1] > 0 > w[2] and abs(w[3:]).max() < 0.5 and cut[0] < cut[1]


def test_toxicity(spark):
    rng = random.Random(4)
    bad, good = ["idiot", "loweiung", "loweikeit"], [f"word{i}" for i in range(200)]
    rows, grades = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = " ".join(rng.choice(good) for _ in range(60)) + (" " + rng.choice(bad) + "! " if toxic else "")
        rows.append((i, text, "clash", 1.0))
        if i % 2 == 0:
            grades.append((i, (2 if i % 3 else 1) if toxic else 0))
    rows += [(None, "idiot", "x", 1.0), (1001, None, "x", 1.0), (1002, "", "x", 1.0), (1003, "loweischaft", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string, toxic double")
    labels = spark.createDataFrame([*grades, (None, 1), (5000, None)], "doc_id long, grade int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].toxic == (i % 5 == 0) for i in range(600))
    assert got[1003].toxic and not got[1001].toxic and not got[1002].toxic  # an unseen word with a known beginning
    assert all(0 <= r.expected_severity <= 2 for r in got.values())
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs, empty).count() == len(rows)


def test_grades_need_a_toxic_label(spark):
    rows = [(1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, 0, None), (6, 1, None), (7, None, 1), (8, None, 0), (None, 0, 1)]
    got = queries.toxicity_grades(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert [r.grade for r in got] == [0, 0, 1, 2, None, None, 1, 0, 2]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in url_rules.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def brute_mining(rows, support, confidence):
    totals, hits = collections.Counter(), {"block": collections.Counter(), "allow": collections.Counter()}
    for tokens, blocked in rows:
        for size in (1, 2, 3):
            for p in itertools.combinations(sorted(set(tokens)), size):
                totals[p] += 1
                hits["block" if blocked else "allow"][p] += 1
    out = []
    for verdict, own in hits.items():
        good = {p: k / totals[p] for p, k in own.items() if k >= support * len(rows) and k / totals[p] >= confidence}
        out += [(p, c, own[p] / len(rows), verdict) for p, c in good.items() if not any(good.get(q, -1) >= c for size in range(1, len(p)) for q in itertools.combinations(p, size))]
    return out


def test_url_rules(spark):
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/x", "https://www.example.com/en/", "https://example.com", "https://example.com/", "https://notexample.com/en/", "x://net/es/", "https://a.net/es", "https://a.net/es/?q=http://b.com/", "http://É.com/x", "http://com/", "http://h?x=1", "http://u@example.com:80/en/", "a\nhttp://b.net/fr/x"]
    urls += [f"https://{rng.choice(['m', 'www', 'blog'])}.s{rng.randrange(9)}.{rng.choice(['example.com', 'x.net', 'y.org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(999)}.html" for _ in range(300)]
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, "http://a.com/", "h", "v"), (0, None, "h", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = url_rules.judge(pages, min_support=0.01).collect()
    assert len(got) == len(rows)
    parts = url_rules.with_parts(pages).where("host <> ''").select("page_id", url_rules.tokens().alias("t"))
    tokens = {r.page_id: set(r.t) for r in parts.collect()}
    told = url_rules.labelled_urls(pages).where("verdict is not null").select("tokens", (F.col("verdict") == "block").alias("blocked")).collect()
    mined = brute_mining([(r.tokens, r.blocked) for r in told], 0.01, 0.9)
    decided = collections.Counter()
    for r in got:
        host, path, best = brute_rule(urls[r.page_id] if r.page_id is not None else "http://a.com/")
        assert (r.host, r.path) == (host, path)
        if best:
            assert (r.verdict, r.rule) == best and r.mined_rule is None
        else:
            own = tokens.get(r.page_id, set()) if r.page_id is not None else set()
            fulfilled = [(-c, -s, v != "block", " & ".join(p), v) for p, c, s, v in mined if set(p) <= own]
            best = min(fulfilled, default=None)
            assert r.rule is None and (r.verdict, r.mined_rule, r.confidence) == ((best[4], best[3], -best[0]) if best else ("allow", None, None))
            decided[r.verdict, best is not None] += 1
    assert decided["block", True] > 10 and decided["allow", True] > 10 and decided["allow", False] > 0
    assert url_rules.judge(pages.limit(0)).count() == 0
    held = url_rules.held_out(pages, min_support=0.01).first()
    assert held.decided > 20 and held.right >= 0.9 * held.ruled > 0.5 * held.decided


def test_mined_rules_have_their_confidence(spark):
    rows = [(["p:casino", f"h:{i % 7}"], True) for i in range(40)] + [([f"h:{i % 7}", "p:news"], False) for i in range(60)] + [(["p:casino", "p:news"], False)]
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.05, 0.9)
    assert (["p:casino"], 40 / 41, 40 / 101) in [(a, b, c) for a, b, c in rules]
    assert all(c >= 0.9 for _, c, _ in rules) and not any(set(a) > {"p:casino"} and b <= 40 / 41 for a, b, _ in rules)


def test_mining_equals_brute_force(spark):
    rng = random.Random(12)
    rows = [([f"p:{i}", f"h:{i % 3}"], True) for i in range(400) for _ in range(3)]
    rows += [([f"q:{j}" for j in range(20) if rng.random() < 0.7], rng.random() < 0.5) for _ in range(120)]
    rows += [([f"h:{i % 3}", f"p:{i}"], False) for i in range(0, 40)]
    totals, hits = collections.Counter(), collections.Counter()
    for tokens, blocked in rows:
        for size in (1, 2, 3):
            for p in itertools.combinations(sorted(tokens), size):
                totals[p] += 1
                hits[p] += blocked
    good = {p: k / totals[p] for p, k in hits.items() if k >= 0.002 * len(rows) and k / totals[p] >= 0.7}
    want = {p: c for p, c in good.items() if not any(good.get(q, -1) >= c for size in range(1, len(p)) for q in itertools.combinations(p, size))}
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean").repartition(3), 0.002, 0.7)
    assert {tuple(p): (c, s) for p, c, s in rules} == {p: (c, hits[p] / len(rows)) for p, c in want.items()}
    assert len({t for p, _, _ in rules for t in p}) > 256 and max(map(len, want)) == 3


def test_long_urls_are_mined_whole(spark):
    same = [f"p:{i}" for i in range(240)]
    rows = [(["h:com", *same], True)] * 3 + [(["h:com", f"p:x{i}"], False) for i in range(5)] + [(["h:com", *same[:120]], False)]
    found = url_rules.rules_of(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
    assert found.rules.count() < 20 and {r.t for r in found.items.collect()} >= set(same)
    told = url_rules.spelled_out(found).where("verdict = 'block'").collect()
    assert {tuple(r.tokens) for r in told} == {(t,) for t in same[120:]}
    # 20 tokens a row, none of one verdict only: pairs and triples come from unions of blocks
    rng = random.Random(3)
    mixed = [(rng.sample([f"q:{j}" for j in range(24)], 20), rng.random() < 0.5) for _ in range(24)]
    want = [(p, c, s, v) for p, c, s, v in brute_mining(mixed, 0.25, 0.7)]
    got = url_rules.spelled_out(url_rules.rules_of(spark.createDataFrame(mixed, "tokens array<string>, blocked boolean"), 0.25, 0.7)).collect()
    assert sorted((tuple(r.tokens), r.confidence, r.support, r.verdict) for r in got) == sorted(want) and max(len(p) for p, *_ in want) == 3


def test_mining_without_rows(spark):
    empty = spark.createDataFrame([], "tokens array<string>, blocked boolean")
    none = spark.createDataFrame([(None, True), ([], False), (["h:a"], None)], "tokens array<string>, blocked boolean")
    assert url_rules.mine(empty) == [] and url_rules.mine(none) == []
    assert {tuple(r.tokens) for r in url_rules.spelled_out(url_rules.rules_of(none)).collect()} == {("h:a",)}


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(8)
    phrases = [p for p, _ in license_scan.BASE]
    vocabulary = "under the mit license apache version 2 cc by nc É日 x y".split()
    texts = [None, "", "Under THE MIT-license; cc/by/nc", "under the mit  license under the mit license", "apache license version 20", "Licensed under the GNU General Public License, version 3.", "All rights reserved."]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) + rng.choice(["", ". " + rng.choice(phrases)]) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "w", 0.5) for i, t in enumerate(texts)] + [(None, "cc by nc", "w", 0.5)], "doc_id long, text string, words string, score double")
    rows = license_scan.scan(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r.doc_id] if r.doc_id is not None else "cc by nc"
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [(k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    found = {r.doc_id: r for r in rows}
    assert "gpl-3" in found[5].labels and found[6].labels == "all-rights-reserved" and found[0].labels == ""
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_secret_scan(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["tion", "the", "ing", "and", "er"]) for _ in range(7))
    rows = []
    for i in range(300):
        text = " ".join(word() if rng.random() < 0.1 else "some" for _ in range(40))
        if i % 3 == 0:
            text += f' token = "{rng.getrandbits(160):040x}" end'
        if i % 3 == 1:
            text += f" card {rng.randrange(10**15, 10**16)} end"
        rows.append((i, text, "src", 1.0))
    rows += [(None, 'password="0123456789abcdef0123"', None, 1.0), (900, None, None, 1.0), (901, "", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, value double")
    got = secret_scan.scan(docs).collect()
    for r in got:
        is_token = r.doc_id is None or r.doc_id % 3 == 0 and len(r.value) == 40
        if r.shape == "hex":
            assert r.secret == is_token
        elif r.value.isalpha():
            assert not r.secret
    assert sum(r.secret for r in got) == 101
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_forest_on_held_out_findings(spark):
    words = ["tion", "the", "ing", "and", "other", "schen", "reelle", "heit"]
    r = secret_scan.held_out(spark, words, 4000).first()
    assert r.secrets > 150 and r.right >= 0.95 * r.secrets and r.right >= 0.95 * r.kept
    truth = secret_scan.planted(spark, words, 4000)
    assert truth.where("label = 0").join(secret_scan.findings(truth), "doc_id", "left_semi").count() > 1000


def test_scan_takes_given_labels(spark):
    docs = spark.createDataFrame([(i, f"see {'ab' * 10 if i % 2 else 'xyzw' * 6} end", "s") for i in range(60)], "doc_id long, text string, source string")
    words = secret_scan.dictionary_words(docs)
    given = secret_scan.with_features(secret_scan.findings(docs), secret_scan.triples_of(words)).withColumn("label", (F.col("value").startswith("xyz")).cast("int"))
    assert all(r.secret == r.value.startswith("xyz") for r in secret_scan.scan(docs, given).collect())


def test_dictionary_counts_every_document(spark):
    rows = [(i, "common words" + (" seldom" if i % 50 == 0 else "") + (" never" if i == 7 else "")) for i in range(6000)]
    rows += [(6000 + i, f"x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}") for i in range(600)]
    rows += [(8000 + i, " ".join("".join("bcdfghjklm"[int(c)] for c in f"{w:04d}") for w in range(3200))) for i in range(70)]
    triples = secret_scan.dictionary(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {"com", "sel", "dom"} <= set(triples) and "nev" not in triples and "xak" not in triples
    assert len([t for t in triples if set(t) <= set("bcdfghjklm")]) >= 1000  # more words than any fixed number of 3000


def brute_nearest(ids, vectors, k):
    out = []
    for i in range(len(ids)):
        if ids[i] % 20:
            continue
        score = vector_search.exact(np.repeat(vectors[i : i + 1], len(ids), 0), vectors)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_vector_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    v = (centres[rng.integers(0, 6, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    v[100:160] = v[100]  # many equal vectors: ties go to the smaller id
    rows = [(i, x.tolist(), 0, 1.0) for i, x in enumerate(v)]
    rows.append(rows[40])
    odd = [(None, [1.0] * 16, 0, 1.0), (2000, None, 0, 1.0), (2020, [0.0] * 16, 0, 1.0), (2040, [float("nan")] * 16, 0, 1.0), (2060, [float("inf")] * 16, 0, 1.0), (2080, [None] * 16, 0, 1.0), (2100, [], 0, 1.0), (3000, [1.0, 2.0], 0, 1.0), (3001, [3.0, 1.0], 0, 1.0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int, score double").repartition(3)
    want = brute_nearest(np.arange(900), v.astype(np.float64), 20) + [(3000, 1, 3001)]
    exact = vector_search.nearest(df, factor=1.0, shard_rows=128, block_rows=16)
    assert exact.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in exact.collect()) == sorted(want)
    close = {(r.query_id, r.vec_id) for r in vector_search.nearest(df, shard_rows=128).collect()}
    pairs = {(q, i) for q, _, i in want}
    assert len(close & pairs) / len(pairs) >= 0.9
    assert vector_search.nearest(df.limit(0)).count() == 0
    assert vector_search.nearest(df.where(F.col("vec_id").isin(0, 1, 2))).count() == 2


def test_vector_search_breaks_ties_by_id(spark):
    rng = np.random.default_rng(8)
    v = np.stack([np.full(501, 0.5), rng.permutation(np.linspace(-0.8, 0.8, 501))], 1).astype(np.float32)
    v[0] = (1.0, 0.0)  # 500 different vectors have the same score for it
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    one = df.where("vec_id = 0 or vec_id % 20 <> 0")
    got = vector_search.nearest(one, factor=1.0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(r + 1, i) for r, i in enumerate([i for i in range(1, 500) if i % 20][:20])]
    relaxed = sorted(vector_search.nearest(one, factor=2.0).collect(), key=lambda r: r.rank)
    assert [r.rank for r in relaxed] == list(range(1, 21)) and {r.score for r in relaxed} == {0.5} and [r.vec_id for r in relaxed] == sorted({r.vec_id for r in relaxed})
    want = brute_nearest(np.arange(501), v.astype(np.float64), 20)
    exact = vector_search.nearest(df, factor=1.0, shard_rows=100, block_rows=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in exact) == want


def test_vector_search_counts_one_vector_of_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 3.0]), (1, [2.0, 1.0]), (2, [5.0, 1.0])]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 1.0), (2, 2, 1.0)]
