"""Full-text search over page texts: an inverted index as a table and BM25 in joins."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.session import materialise

#: Fixed values of the ranking function, and bounds of the index.
K1, B = 1.2, 0.75
MAX_PAGES, MAX_CHARS = 600, 40_000
WORD = r"[\p{L}\p{N}]+"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīįłńňōőœřśšťūůűźżžß"
_PLAIN = "".join((unicodedata.normalize("NFD", c)[0] if c not in "đłœß" else {"đ": "đ", "ł": "ł", "œ": "œ", "ß": "ß"}[c]) for c in _ACCENTED)


def folded(text):
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def postings(texts: DataFrame, doc: str | Column, text: str) -> DataFrame:
    """(doc, term, tf, positions) of each document's terms; a struct as ``doc`` keys documents by several columns."""
    key = F.col(doc) if isinstance(doc, str) else doc
    words = F.regexp_extract_all(folded(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    each = texts.select(key.alias("doc"), F.posexplode_outer(words).alias("pos", "term")).where("term is not null")
    return each.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def parse_query(query: str) -> list[tuple[list[str], bool]]:
    """Phrases of a query and whether the last word of each may be a prefix: words AND together, the last is a prefix."""
    import regex

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    phrases = [regex.findall(WORD, part) for part in plain.split()]
    phrases = [p for p in phrases if p]
    return [(p, i == len(phrases) - 1) for i, p in enumerate(phrases)]


def bm25(texts: DataFrame, doc: str, text: str, query: str, limit: int = 50) -> DataFrame:
    """(doc, score): documents with every phrase of ``query``, best first; scores are negative, smaller is better.

    A phrase's words stand consecutively; the last word of the query may be a
    prefix. A blank query finds nothing. Phrase occurrences are counted within a
    row from the positions of the query's words only.
    """
    phrases = parse_query(query)
    if not phrases:
        return texts.select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    plain = folded(F.coalesce(F.col(text), F.lit("")))
    counters = []
    for words_, prefix in phrases:

        def starts(hs, words_=tuple(words_), prefix=prefix):
            """Runs of hits, (place, word) in order, that are the phrase."""

            def begins(h, i):
                ok = F.lit(True)
                for k, w in enumerate(words_):
                    here = F.get(hs, i + k)
                    fits = here["w"].startswith(w) if prefix and k == len(words_) - 1 else here["w"] == w
                    ok = ok & fits & (here["i"] == h["i"] + k)
                return F.coalesce(ok, F.lit(False))

            return F.size(F.filter(hs, begins))

        counters.append(starts)
    exact = sorted({w for ws, prefix in phrases for w in (ws[:-1] if prefix else ws)})
    begun = [ws[-1] for ws, prefix in phrases if prefix]

    def asked(h):
        """Whether a word of the text is one of the query's."""
        ok = h["w"].isin(exact) if exact else F.lit(False)
        for w in begun:
            ok = ok | h["w"].startswith(w)
        return ok

    def counts(ws):
        placed = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), asked)
        return F.struct(F.size(ws).alias("len"), let(placed, lambda hs: F.array(*[f(hs) for f in counters])).alias("tf"))

    # a text without any of the words is only counted: its places are not looked at
    some = plain.rlike("|".join(sorted({*exact, *begun})))  # words are letters and digits only
    words = F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))
    none = F.array(*[F.lit(0)] * len(phrases))
    facts_of = F.when(some, let(words, counts)).otherwise(F.struct(F.regexp_count(plain, F.lit(WORD)).alias("len"), none.alias("tf")))
    # read twice below; a row for each text, without the text
    rows = materialise(texts.select(F.col(doc).alias("doc"), facts_of.alias("x")).select("doc", "x.len", "x.tf"))
    facts = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(phrases))]).first()
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df = facts[f"df{i}"]
        idf = max(math.log((facts["n"] - df + 0.5) / (df + 0.5)), 1e-6)
        tf = F.col("tf")[i]
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(facts["avg_len"] or 1.0))))
    hits = rows.where(F.forall("tf", lambda t: t > 0)).select("doc", F.round(score, 9).alias("score"))
    return hits.orderBy("score", "doc").limit(min(max(limit, 1), 200))


def index_rows(pages: DataFrame, scan: str) -> DataFrame:
    """(scan, timestamp, url, text) of a scan's pages: the first ``MAX_PAGES`` in processing order, the empty ones of them left out, texts cut to ``MAX_CHARS``.

    ``pages`` carry page_seq, timestamp, url and the visible text. The bounds are the
    index's own.
    """
    first = pages.orderBy("page_seq").limit(MAX_PAGES)
    return first.where("text is not null and text <> ''").select(F.lit(scan).alias("scan"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.coalesce("url", F.lit("")).alias("url"), F.left("text", F.lit(MAX_CHARS)).alias("text"))


def reindex(index: DataFrame, pages: DataFrame, scan: str) -> DataFrame:
    """The index with a scan's rows replaced."""
    return index.where(F.col("scan") != scan).unionByName(index_rows(pages, scan))


def search_scan(index: DataFrame, scan: str, query: str, limit: int = 50) -> DataFrame:
    """(url, timestamp, snippet, score): a scan's pages with every word of the query, best first."""
    own = index.where(F.col("scan") == scan).withColumn("_doc", F.struct("url", "timestamp"))
    best = bm25(own, "_doc", "text", query, limit)
    found = own.join(F.broadcast(best), own["_doc"] == best["doc"])  # ``limit`` rows
    return found.select("url", "timestamp", snippet(F.col("text"), query).alias("snippet"), "score").orderBy("score", "url", "timestamp")


def snippet(text: Column, query: str, size: int = 12) -> Column:
    """The ``size`` words of a text with most words of the query (the first such place), these between marks; dots stand for the rest."""
    phrases = parse_query(query)
    exact = sorted({w for ws, prefix in phrases for w in (ws[:-1] if prefix else ws)})
    begun = [ws[-1] for ws, prefix in phrases if prefix]
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\p{L}\p{N}]*[\p{L}\p{N}]+"), F.lit(0))

    def asked(piece: Column) -> Column:
        word = folded(F.regexp_extract(piece, WORD, 0))
        ok = word.isin(exact) if exact else F.lit(False)
        for w in begun:
            ok = ok | word.startswith(w)
        return ok

    def shown(ps: Column, hits: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ps) - size, F.lit(0)))
        count = F.transform(starts, lambda s: F.size(F.filter(F.slice(hits, s + 1, size), lambda h: h)))
        best = (F.array_position(count, F.array_max(count)) - 1).cast("int")
        body = F.transform(F.slice(ps, best + 1, size), lambda p: F.when(asked(p), F.regexp_replace(p, f"({WORD})$", "<mark>$1</mark>")).otherwise(p))
        ahead, behind = F.when(best > 0, " \u2026 ").otherwise(""), F.when(best + size < F.size(ps), " \u2026 ").otherwise("")
        return F.concat(ahead, F.regexp_replace(F.array_join(body, ""), r"^\s+", ""), behind)

    return let(pieces, lambda ps: F.when(F.size(ps) > 0, let(F.transform(ps, asked), lambda hits: shown(ps, hits))).otherwise(""))
