"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that would
    be one executor's own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return jsc.getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder for tables of a query, removed when the driver's interpreter exits."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation. Files are removed
    by :func:`discard` or when the driver's interpreter exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts that :func:`spread` makes of each scanned partition where work is heavy for each row.
PIECES = 8


def spread(df: DataFrame, pieces: int = 1) -> DataFrame:
    """A scanned table over as many partitions as there are cores, where its files give fewer.

    For work that is heavy for each row, on inputs too small to be split; larger ones
    are returned as they are, without a shuffle. With ``pieces`` each partition of a larger one
    is dealt over so many, so that no task holds a whole split of compressed rows that take
    far longer to work on than to read; the number of tasks follows the input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    scanned = df.rdd.getNumPartitions()
    return df.repartition(max(cores, pieces * scanned)) if scanned < cores or pieces > 1 else df


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with its place from 1 in a total order, sorted by ranges: no task sees more than its range.

    Ranges are written with their number; places within one and the sizes of those before
    it give the place.
    """
    part = f"_{name}_part"
    ranged = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_size"))
    before = sizes.select(part, (F.sum("_size").over(W.orderBy(part)) - F.col("_size")).alias("_before"))  # a row for each range
    place = F.row_number().over(W.partitionBy(part).orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(before), part).withColumn(name, place).drop(part, "_before")


def running(df: DataFrame, groups: list[str], order: list, **values) -> DataFrame:
    """``df`` with running sums of ``values`` within each group, up to and with each row in a total order.

    Groups are laid out by ranges, so a group of any size is spread over tasks: a row's sum is
    that of its range and of the group's ranges before it, of which there are as many as
    ranges. A value of 1 gives a row's place from 1.
    """
    part, held = "_running_part", {k: f"_value_{k}" for k in values}
    valued = df.withColumns({held[k]: v for k, v in values.items()})
    ranged = materialise(valued.repartitionByRange(*groups, *order).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(*groups, part).agg(*[F.sum(c).alias(c) for c in held.values()])
    earlier = W.partitionBy(*groups).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a group
    before = sums.select(*[F.col(g).alias(f"_before_{g}") for g in groups], F.col(part).alias("_before_part"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in held.values()])
    same = F.col(part) == F.col("_before_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_before_{g}"))
    inner = W.partitionBy(part, *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.withColumns({k: F.sum(c).over(inner) for k, c in held.items()}).join(before, same)
    return out.select(*[c for c in df.columns if c not in values], *[(F.col(k) + F.col(f"_before{c}")).alias(k) for k, c in held.items()])
