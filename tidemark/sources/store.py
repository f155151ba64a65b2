"""Tables that are written in place: upsert, replacement, deletion and expiry.

A table is partitioned by a bucket of its key. A change reads and writes the buckets it
touches and no others, by dynamic partition overwrite: their new files take the place of
the old ones when the job commits, so a failed write leaves the table as it was and can
be repeated. A bucket left without rows is removed after that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import discard, materialise

#: Buckets of a new table.
BUCKETS = 64


@dataclass
class KeyedTable:
    """A table under ``path`` with rows by ``key``; ``schema`` leaves the bucket out."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _files(self):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _stored(self) -> DataFrame:
        target, files = self._files()
        schema = f"{self.schema}, bucket int"
        return self.spark.read.schema(schema).parquet(self.path) if files.exists(target) else self.spark.createDataFrame([], schema)

    def get(self, value) -> DataFrame:
        """The rows of one key: one bucket is read."""
        row = self.spark.range(1).select(F.lit(value).cast(dict(self.rows().dtypes)[self.key]).alias(self.key))
        bucket = row.select(self._bucket().alias("b")).first().b
        return self._stored().where((F.col("bucket") == bucket) & (F.col(self.key) == F.lit(value))).drop("bucket")

    def _rewrite(self, touched: list[int], rows: DataFrame) -> None:
        """Makes ``rows`` all that the touched buckets hold."""
        if not touched:
            return
        made = materialise(rows.withColumn("bucket", self._bucket()))
        left = {r.bucket for r in made.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        discard(made)
        target, files = self._files()
        for k in touched:
            if k not in left:
                files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, f"bucket={k}"), True)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r.b for r in keys.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, new: DataFrame, preserve: tuple[str, ...] = ()) -> None:
        """Puts rows in place of those with the same key; ``preserve`` columns keep what the table has, unless that is null.

        Of several new rows of a key the one that is greatest by its other columns stays.
        """
        names = self.rows().columns
        others = [c for c in names if c != self.key]
        one = materialise(new.groupBy(self.key).agg(F.max(F.struct(*others)).alias("_new")).select(self.key, *[F.col(f"_new.{c}").alias(c) for c in others]))
        touched = self._touched(one)
        old = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
        kept = old.join(one.select(self.key), self.key, "left_anti")
        before = old.select(self.key, *[F.col(c).alias(f"_old_{c}") for c in preserve])
        put = one.join(before, self.key, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in preserve else F.col(c) for c in names]) if preserve else one.select(*names)
        self._rewrite(touched, kept.unionByName(put))
        discard(one)

    def replace(self, new: DataFrame) -> None:
        """Puts all rows of ``new`` in place of all rows of their keys; a key may have many."""
        new = materialise(new.select(*self.rows().columns))
        touched = self._touched(new)
        old = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
        self._rewrite(touched, old.join(new.select(self.key).distinct(), self.key, "left_anti").unionByName(new))
        discard(new)

    def delete(self, condition: Column) -> None:
        """Removes the rows that fulfil ``condition``; a condition that is null keeps its row."""
        gone = F.coalesce(condition, F.lit(False))
        touched = sorted(r.bucket for r in self._stored().where(gone).select("bucket").distinct().collect())
        self._rewrite(touched, self._stored().where(F.col("bucket").isin(touched) & ~gone).drop("bucket"))

    def keep_only(self, keys: DataFrame) -> None:
        """Removes the rows whose key is not among ``keys``."""
        orphans = materialise(self.rows().select(self.key).distinct().join(keys.select(self.key).distinct(), self.key, "left_anti"))
        touched = self._touched(orphans)
        own = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
        self._rewrite(touched, own.join(orphans, self.key, "left_anti"))
        discard(orphans)
