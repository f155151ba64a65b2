"""Operators 11, 12 and 13 against the libraries and brute force."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, source_audit, token_alignment, token_counts
from tidemark.llm.bpe import byte_alphabet

os.environ["TOKENIZERS_PARALLELISM"] = "false"
A, B = queries.vocabulary_path(), queries.vocabulary_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
PIECES = ["a", "the", "'s", "'", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "\r\n", " \n", "é", "日本", "🙂", "1", "234", ".", "!!", "<|endoftext|>", "<|end", "Ing", " ", "\x1c", "\x85", "é", "aaaa", "      ", "_", "'S", "　", "▁", "<s>", "<0x41>", "ﬁ", "\x00"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def prefixes(lib, text):
    return [len(e.ids) for e in lib.encode_batch([text[:i] for i in range(1, len(text) + 1)], add_special_tokens=False)]


def test_every_prefix_is_counted(spark):
    lib, texts = library(), [*random_texts(5, 400), None, "", "x" * 300 + " " * 200 + "=-" * 150]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "it's", "c", 1), (0, texts[0], "c", 1)], "doc_id long, text string, counts string, n_tokens int")
    stored = token_counts.prefix_counts(docs.repartition(3), A)
    got = stored.select("*", token_counts.tokens_before(F.col("counts"), F.lit(3)).alias("first"), token_counts.longest_within(F.col("counts"), 4).alias("fit")).collect()
    assert len(got) == len(texts) + 2
    quick = {r.doc_id: r for r in token_counts.token_counts(docs, A, limit=4).collect()}
    for r in got:
        text = "it's" if r.doc_id is None else texts[r.doc_id] or ""
        want = prefixes(lib, text)
        assert r.counts == want and r.n_tokens == (want[-1] if want else 0), text
        assert r["first"] == (want[min(3, len(want)) - 1] if want else 0)
        fit = max((i + 1 for i, n in enumerate(want) if n <= 4), default=0)
        q = quick[r.doc_id]
        assert r.fit == q.fit_chars == fit
        assert (q.n_tokens, q.n_bytes, q.over_limit) == (r.n_tokens, len(text.encode()), r.n_tokens > 4)
    assert token_counts.token_counts(docs.limit(0), A).count() == 0


def test_token_counts_of_the_whole_table(spark):
    lib = library()
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_token_counts(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(lib.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert len(lib.encode(rows[r.doc_id][: r.fit_chars], add_special_tokens=False).ids) <= 512


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY_UNITS", 5)
    own, lib = token_counts.PrefixCounter(A), library()
    for text in random_texts(8, 40):
        counts, per = own.counts(pa.array([text, text + " again"]))
        assert counts.tolist() == prefixes(lib, text) + prefixes(lib, text + " again") and per.tolist() == [len(text), len(text) + 6]


def brute_audit(rows, least, top):
    langs = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    groups = collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        langs[lang or ""][0].update(words)
        langs[lang or ""][1].update(set(words))
    out = []
    for (lang, source), own in groups.items():
        total, docs = langs[lang]
        kept = sorted(t for t, n in docs.items() if n >= least)

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept]

        p, q = shares(own), shares(total)
        pairs = [(-sum((x - y) ** 2 // (x + y) for x, y in zip(p, shares(other), strict=True)), s.encode()) for (g, s), other in groups.items() if g == lang and s != source]
        terms = [(-((x - y) ** 2 // (x + y)), t.encode()) for t, x, y in zip(kept, p, q, strict=True) if own[t] and x > y]
        out += [(lang, source, "pair", s.decode(), -v, r + 1) for r, (v, s) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("block", "tile", "heavy"), [(512, 8192, 0.25), (4, 16, 0.25), (3, 8, 2.0), (4, 8, 0.0)])
def test_source_audit(spark, monkeypatch, block, tile, heavy):
    for name, value in (("BLOCK", block), ("TILE_ROWS", tile), ("HEAVY_SHARE", heavy)):
        monkeypatch.setattr(source_audit, name, value)
    rng = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)] + ["Ünd", "ünd", "日本"]
    rows = [(i, " ".join(rng.choice(words[: 5 + 7 * (i % 22)]) + rng.choice([" ", ", ", "7"]) for _ in range(rng.randrange(40))), rng.choice(["en", "fr"]), f"src{i % 11}") for i in range(400)]
    rows += [(None, "wab WAB wab", None, None), (1, None, "en", "mute"), (2, "", "xx", "alone"), (3, "one two", "yy", "a"), (3, "one two", "yy", "a"), (4, None, "yy", "")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, term string").repartition(3)
    got = sorted(tuple(r) for r in source_audit.audit(docs, 10, 4).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows, 10, 4)
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    n = 10**12
    row = spark.range(1).select(source_audit._share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (3 * n + 14)


def brute_alignment(texts):
    import sentencepiece

    a_lib, b_lib = library(), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    alphabet, names = byte_alphabet(), {v: k for k, v in a_lib.get_vocab(False).items()}
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append(None)
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in parts]).tolist() for parts in (a_bytes, b_bytes))
        groups, before = [], 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            groups.append(tuple([i for i, e in zip(ids, ends, strict=True) if before < e <= cut] for ids, ends in ((a, a_ends), (b, b_ends))))
            before = cut
        docs.append((len(a), len(b), groups))
    count = collections.Counter()
    for d in docs:
        count.update({(x, y) for left, right in (d[2] if d else []) for x in left for y in right})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        links = [(x, y) for left, right in d[2] for x in left for y in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in d[2])
        yield (d[0], d[1], len(d[2]), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("sent", [1 << 20, 64, 0])
def test_token_alignment(spark, monkeypatch, sent):
    monkeypatch.setattr(token_alignment, "SENT_PAIRS", sent)
    texts = [*random_texts(6, 300), None, "", " ", "x" * 3000 + " " * 999 + "日" * 500, "same text", "same text"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, row int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.token_alignment(docs, A, B).collect()}
    assert got == dict(enumerate(brute_alignment(texts)))
    groups = {r.doc_id: r.groups for r in token_alignment.alignments(docs, A, B).collect()}
    assert all(got[i][6] == (hashlib.sha256(g.encode()).hexdigest() if g else "") for i, g in groups.items())


def test_token_alignment_edges(spark):
    docs = spark.createDataFrame([(None, "a text"), (3, "a text"), (3, "a text")], "doc_id long, text string")
    got = token_alignment.token_alignment(docs, A, B).collect()
    assert len(got) == 3 and all(r.count_sum == 3 * r.n_links == 3 * r.n_best > 0 for r in got)
    assert token_alignment.token_alignment(docs.limit(0), A, B).count() == 0


def test_alignment_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_alignment([r.text for r in rows]), strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_token_alignment(spark, SF).collect()} == want


def test_bitset_rank_and_select():
    places = np.array([0, 5, 63, 64, 130])
    own = token_alignment.Bitset.of(places, 131)
    assert own.places().tolist() == places.tolist()
    assert own.rank(np.array([0, 4, 5, 63, 64, 129, 130])).tolist() == [1, 1, 2, 3, 4, 4, 5]
