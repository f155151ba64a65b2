"""Samples of a rule are its own first findings, however far back in their category."""

from pyspark.sql import functions as F

from tidemark.operators.highlights import highlights


def test_samples_come_from_behind_the_first_ranks(spark):
    n = 500
    key = F.when(F.col("id") <= 300, F.concat(F.lit("info"), "id", F.lit("@acme.test"))).otherwise(F.concat(F.lit("j.doe"), "id", F.lit("@acme.test")))
    mails = spark.range(1, n + 1).select(F.lit("emails").alias("category"), key.alias("key"), F.col("id").cast("int").alias("rank"), F.create_map(F.lit("type"), F.lit("x")).alias("attrs"), F.lit("2020-01").alias("first_seen"), F.lit("2020-01").alias("last_seen"))
    ips = spark.range(1, 4).select(F.lit("internal_ips").alias("category"), F.concat(F.lit("10.0.0."), "id").alias("key"), F.col("id").cast("int").alias("rank"), F.create_map(F.lit("type"), F.lit("x")).alias("attrs"), F.lit("2020-01").alias("first_seen"), F.lit("2020-01").alias("last_seen"))
    rows = [tuple(r) for r in highlights(mails.unionByName(ips).repartition(7), "acme.test").collect()]
    assert rows == [
        ("LEAK", "internal_ips", 3, "", "10.0.0.1, 10.0.0.2, 10.0.0.3"),
        ("PIVOT", "emails", 200, "", ", ".join(f"j.doe{k}@acme.test" for k in range(301, 306))),
    ]
