"""Operator 8: secret scan with a random forest against false positives (DataFrame functions and Spark ML only).

Raw findings are long runs of key-like characters. A forest judges each by its
length, character transitions, dictionary coverage, path and neighbouring words. It
is trained from labelled findings: given ones, or planted ones, whose truth is how
they were made and not what the forest sees of them.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.native import let
from tidemark.session import materialise

MIN_LENGTH = 16
#: Bound of what the forest is fitted on (rows, taken by a hash).
MAX_FIT_FINDINGS = 20_000
#: A word is in the dictionary if at least this share of all documents holds it.
DICTIONARY_SHARE = 0.01
TREES, DEPTH, SEED = 20, 6, 17
KEPT = 0.5
#: Planted findings; every fifth measures the forest.
PLANTED = 8000
#: Words that announce a secret, and well-known shapes of one.
KEYWORDS = r"(?i)(passw(or)?d|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
SHAPES = (("aws_access_key", r"^(AKIA|ASIA)[0-9A-Z]{16}$"), ("hex", r"^[0-9a-f]{16,}$"), ("github", r"^gh[pousr]_[0-9A-Za-z]{36,}$"), ("stripe", r"^[sr]k_(live|test)_[0-9A-Za-z]{16,}$"), ("google_api", r"^AIza[0-9A-Za-z_\-]{35}$"), ("slack", r"^xox[abprs]-[0-9A-Za-z\-]{10,}$"))
DECOYS = r"(?i)\b(commit|sha1|sha256|md5|checksum|digest|etag|uuid|build|order|invoice|serial|card|isbn)\b"
FEATURES = ("length", "transitions", "digits", "upper", "variety", "coverage", "keyword", "decoy", "assigned", "quoted", "path_hint", "path_depth")
_RUN = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}={{0,2}}"


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, same, word, value, lead, tail, before, path): every raw finding.

    ``word`` numbers the white-space separated words from 0; ``lead`` and ``tail`` are
    what surrounds the run inside its word, ``before`` the two words in front. Of
    several runs in one word each is a finding.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), place.alias("path"), text.alias("text")).where(F.col("text").rlike(_RUN))
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    placed = let(words, lambda ws: F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("word"), w.alias("w"), F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1)).alias("before"))), lambda x: x["w"].rlike(_RUN)))
    hits = rows.select("doc_id", "same", "path", F.explode_outer(placed).alias("x")).where("x is not null")
    runs = hits.select("doc_id", "same", "path", "x.*", F.posexplode_outer(F.regexp_extract_all("x.w", F.lit(_RUN), F.lit(0))).alias("run", "value"))
    at = F.expr("instr(w, value)")
    return runs.select("doc_id", "same", "word", "run", "value", F.substring("w", F.lit(1), at - 1).alias("lead"), F.expr("substring(w, instr(w, value) + length(value))").alias("tail"), "before", "path")


def dictionary_words(docs: DataFrame, share: float = DICTIONARY_SHARE) -> list[str]:
    """The words that at least ``share`` of all documents hold: as many as a document has distinct words, over ``share``, at most."""
    n = docs.count()
    words = docs.select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{3,12}"), F.lit(0)))).alias("w"))
    return sorted(r.w for r in words.where("w is not null").groupBy("w").count().where(F.col("count") >= share * n).select("w").collect())


def triples_of(words: list[str]) -> list[str]:
    """The letter triples of some words."""
    return sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})


def dictionary(docs: DataFrame, share: float = DICTIONARY_SHARE) -> list[str]:
    """Letter triples of the words that at least ``share`` of all documents hold."""
    return triples_of(dictionary_words(docs, share))


def planted(spark: SparkSession, words: list[str], n: int = PLANTED) -> DataFrame:
    """(doc_id, text, source, label): ``n`` texts with one finding each.

    Label 1: random keys of several alphabets and lengths, announced in several ways
    or, for well-known shapes, not at all. Label 0: compounds, paths and names out of
    ``words``, long numbers, identifiers in hexadecimal groups, checksums, and keys in
    files of tests and examples.
    """
    words = words or ["text", "word", "line", "some", "other"]
    held = words if len(words) <= 500 else words[:: len(words) // 500 + 1]
    lot = lambda salt, k: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)) + 1).cast("int")
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), lot(salt, len(values)))
    some = lambda low, high: F.slice("some", low, high - low + 1)
    head = lambda text, size: F.substring(text, F.lit(1), size)
    digest, mixed = F.col("digest"), F.col("mixed")

    # what several kinds share is written first, so that each stands in the plan once
    base = spark.range(n).withColumn("held", F.array(*map(F.lit, held)))
    base = base.withColumns({"some": F.transform(F.sequence(F.lit(1), F.lit(11)), lambda k: F.element_at("held", (F.pmod(F.xxhash64("id", k), F.lit(len(held))) + 1).cast("int"))), "digest": F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")).cast("binary"), 256)}).drop("held")
    base = materialise(base.withColumn("mixed", F.regexp_replace(F.base64(F.unhex(F.concat(digest, F.sha2(digest.cast("binary"), 256)))), "[+/=]", "")))
    key = F.element_at(F.array(head(digest, lot(4, 49) + 15), head(digest, F.lit(40)), head(mixed, lot(5, 25) + 19), F.base64(F.unhex(digest)), F.concat(F.lit("sk_live_"), head(mixed, F.lit(24)))), lot(6, 5))
    announced = pick(['token = "', "password=", "api_key: ", "secret='", "auth_token=", "Authorization: Bearer ", "access-key = ", "pwd: "], 7)
    base = materialise(base.withColumns({"kind": lot(1, 15), "key": key, "announced": announced, "plain": pick(["", "the ", "see ", "in "], 8)}))
    key, announced, plain, none = F.col("key"), F.col("announced"), F.col("plain"), F.lit("")
    close = F.when(announced.endswith('"'), '"').when(announced.endswith("'"), "'").otherwise("")
    number = head(F.regexp_replace(F.translate(digest, "abcdef", "123456"), "^0", "7"), lot(3, 5) + 15)
    kinds = [
        (1, announced, key, close, "src"),
        (1, announced, key, close, "src"),
        (1, plain, F.concat(F.lit("AKIA"), head(F.upper(mixed), F.lit(16))), none, "src"),
        (1, plain, F.concat(F.lit("ghp_"), head(mixed, F.lit(36))), none, "src"),
        (0, plain, F.concat_ws("", some(1, 7)), none, "src"),
        (0, plain, F.upper(F.concat_ws("", some(1, 5))), none, "src"),
        (0, plain, F.concat_ws("", F.transform(some(1, 5), F.initcap)), none, "src"),
        (0, plain, F.concat_ws("/", some(1, 6)), none, "src"),
        (0, plain, F.concat_ws("_", some(1, 6)), none, "src"),
        (0, pick(["card ", "order ", "", "the "], 9), number, none, "src"),
        (0, pick(["uuid ", "id ", "", "build "], 10), F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 12)), none, "src"),
        (0, pick(["commit ", "sha1 ", "sha256 ", "md5 ", "checksum ", "digest "], 11), head(digest, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), lot(12, 3))), none, "src"),
        (0, announced, key, close, "tests/fixtures/example"),
        (0, announced, F.concat_ws("", some(1, 6)), close, "src"),
        (0, plain, F.repeat(pick(["-", "a", "0", "_"], 13), lot(14, 41) + 19), none, "src"),
    ]
    chosen = None
    for k, (label, before, value, after, path) in enumerate(kinds, 1):
        made = F.struct(F.concat(before, value, after).alias("m"), F.lit(path).alias("path"), F.lit(label).alias("label"))
        chosen = F.when(F.col("kind") == k, made) if chosen is None else chosen.when(F.col("kind") == k, made)
    around = lambda k: F.element_at("some", k)
    made = base.select(F.col("id").alias("doc_id"), "some", chosen.alias("x"))
    return materialise(made.select("doc_id", F.concat_ws(" ", around(8), around(9), "x.m", around(10)).alias("text"), F.concat_ws("/", "x.path", around(11)).alias("source"), "x.label"))


def planted_findings(spark: SparkSession, words: list[str], n: int = PLANTED) -> DataFrame:
    """The findings of :func:`planted` with features and label; a short or dictionary word gives none."""
    made = planted(spark, words, n)
    return materialise(with_features(findings(made), triples_of(words)).join(F.broadcast(made.select("doc_id", "label")), "doc_id"))


def held_out(spark: SparkSession, words: list[str], n: int = PLANTED) -> DataFrame:
    """One row (kept, right, secrets): of every fifth planted finding, how many a forest of the others keeps, how many of these rightly, and how many are secrets."""
    found = planted_findings(spark, words, n)
    fifth = F.pmod("doc_id", F.lit(5)) == 0
    judged = judge(found.where(fifth), fit(found.where(~fifth)))
    return judged.agg(F.count_if("secret").alias("kept"), F.count_if(F.col("secret") & (F.col("label") == 1)).alias("right"), F.count_if(F.col("label") == 1).alias("secrets"))


def with_features(found: DataFrame, triples: list[str]) -> DataFrame:
    """Adds the forest's features; none is null."""
    value, size = F.col("value"), F.length("value").cast("double")
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "#"), "[a-z]", "a"), "[A-Z]", "A"), "+/_-=", ".....")
    changes = F.length(F.regexp_replace(classes, r"(.)\1*", "x")).cast("double")
    low = F.lower(value)
    grams = F.transform(F.sequence(F.lit(1), F.length("value") - 2), lambda i: F.substring(low, i, F.lit(3)))
    covered = F.size(F.filter(grams, lambda g: g.isin(triples))) / F.greatest(size - 2, F.lit(1.0)) if triples else F.lit(0.0)
    place = F.coalesce("path", F.lit(""))
    return found.withColumns(
        {
            "length": size,
            "transitions": changes / size,
            "digits": F.length(F.regexp_replace(value, "[^0-9]", "")) / size,
            "upper": F.length(F.regexp_replace(value, "[^A-Z]", "")) / size,
            "variety": F.size(F.array_distinct(F.split(value, ""))) / size,
            "coverage": covered.cast("double"),
            "keyword": F.concat_ws(" ", "before", "lead").rlike(KEYWORDS).cast("double"),
            "decoy": F.concat_ws(" ", "before", "lead").rlike(DECOYS).cast("double"),
            "assigned": F.concat_ws(" ", "before", "lead").rlike(r"[=:]\s*[\"']?\s*$").cast("double"),
            "quoted": (F.col("lead").rlike("[\"']$") & F.col("tail").rlike("^[\"']")).cast("double"),
            "path_hint": place.rlike(r"(?i)(test|example|fixture|sample|mock)").cast("double"),
            "path_depth": F.size(F.split(place, "/")).cast("double"),
        }
    )


def shape() -> Column:
    out = F.lit("other")
    for name, pattern in reversed(SHAPES):
        out = F.when(F.col("value").rlike(pattern), name).otherwise(out)
    return out


def fit(labelled: DataFrame, max_fit: int = MAX_FIT_FINDINGS) -> RandomForestClassificationModel | float:
    """A forest from ``labelled(features..., label)``: about ``max_fit`` findings of each label, taken by a hash.

    With findings of one label only, that label stands for the forest; with none, 1 (every raw finding stays).
    """
    counts = {int(r.label): r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 1))
    lot = F.pmod(F.xxhash64("value", "before", "doc_id", "word"), F.lit(1_000_000))
    limit = F.when(F.col("label") == 1, int(min(1.0, max_fit / counts[1]) * 1_000_000)).otherwise(int(min(1.0, max_fit / counts[0]) * 1_000_000))
    sample = labelled.where(lot < limit).select(*FEATURES, F.col("label").cast("double").alias("label"))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(assembled)


def judge(found: DataFrame, forest: RandomForestClassificationModel | float) -> DataFrame:
    """Adds ``probability`` and ``secret``."""
    if isinstance(forest, float):
        return found.withColumns({"probability": F.lit(forest), "secret": F.lit(forest >= KEPT)})
    rated = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    return rated.withColumn("probability", vector_to_array("probability")[1]).withColumn("secret", F.col("probability") >= KEPT)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """(doc_id, word, run, value, shape, probability, secret) of every raw finding in ``docs(doc_id, text)``.

    ``labelled`` holds findings with features and ``label``; without it
    :func:`planted_findings` serve. A null or empty text has no finding; a null doc_id is
    kept; repeated rows give repeated findings; a missing or null path is an empty
    one; other columns are ignored; an empty table gives no rows. The dictionary
    counts all documents, the forest is fitted on a bounded sample, and everything is
    judged.
    """
    words = dictionary_words(docs)
    forest = fit(planted_findings(docs.sparkSession, words) if labelled is None else labelled)
    found = with_features(findings(docs, path), triples_of(words)).withColumn("shape", shape())
    return judge(found, forest).select("doc_id", "word", "run", "value", "shape", "probability", "secret")
