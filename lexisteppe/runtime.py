"""Session plumbing shared by all operators: shipping code, checkpoints and size-checked joins."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@functools.cache
def _archive(context_id: str) -> str:
    path = Path(tempfile.mkdtemp(prefix="lexisteppe-")) / "lexisteppe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    return str(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each Spark application.

    The archive is built on the driver and served to the executors by Spark itself.
    """
    sc = spark.sparkContext
    key = f"{sc.applicationId}-{os.getpid()}"
    if key not in _shipped:
        sc.addPyFile(_archive(key))
        _shipped.add(key)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, in the folder that the cluster names in ``spark.checkpoint.dir``.

    On one machine (a local master) an own folder is used where none is named, and removed at the program's end;
    on a cluster a missing setting is an error, since a folder of one machine does not survive it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexisteppe-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def sliced(kernel: Callable, rows: int) -> Callable:
    """A kernel over record batches of at most so many rows each; batches that Spark sends are cut, not copied."""

    def run(batches: Iterator) -> Iterator:
        return kernel(b.slice(at, rows) for b in batches for at in range(0, max(b.num_rows, 1), rows))

    return run


def arrow_map(df: DataFrame, kernel: Callable, schema: str, rows_per_batch: int = 1000) -> DataFrame:
    """``mapInArrow`` with batches of at most so many rows for the kernel, so that what it builds from long texts stays
    within a worker's memory. No setting of the session is changed."""
    ship_package(df.sparkSession)
    return df.mapInArrow(sliced(kernel, rows_per_batch), schema)


MOST_BYTES = 64 << 20


def is_small(df: DataFrame, most_bytes: int = MOST_BYTES) -> bool:
    """Whether the rows of a written table, measured as text and with an allowance for each, stay below a size.

    Rows are counted first, so that a table of very many rows is not read through.
    """
    rows = df.count()
    if rows * 16 > most_bytes:
        return False
    width = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0))
    return (df.agg(F.sum(width + 32)).first()[0] or 0) <= most_bytes


def small_set(df: DataFrame | None, most_bytes: int = MOST_BYTES // 8) -> frozenset[str] | None:
    """The values of a table's first column, if few bytes hold them: what workers may look up; else nothing."""
    if df is None:
        return frozenset()
    values = checkpointed(df.select(F.col(df.columns[0]).alias("v")).where("v is not null").distinct())
    return frozenset(r.v for r in values.toLocalIterator()) if is_small(values, most_bytes) else None


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most_bytes: int = MOST_BYTES, salts: int = 16) -> DataFrame:
    """Join a large side with one that is probably small.

    The right side is written and its bytes are counted first. Up to ``most_bytes`` it is broadcast; beyond, the join
    shuffles with every right row repeated ``salts`` times and the left rows spread over the repeats, so that
    one hot key is not one task. ``how`` is inner, left_semi or left.
    """
    right = checkpointed(right)
    if is_small(right, most_bytes):
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread: Column = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    return left.withColumn("_salt", spread).join(salted, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame, *keys: str, small_bytes: int = 64 << 20) -> DataFrame:
    """Rows over all cores, for work that is heavy for each row.

    With keys, rows are partitioned by them into as many parts as shuffles have, which windows and groups over the
    keys then use and which adaptive planning does not merge for their few bytes. Without keys, only an input from
    few bytes of files, which may lie in fewer splits than there are cores, is moved; a large one is left as it is.
    The size is the planner's estimate of all tables read: no job is run for it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if keys:
        return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores), *keys)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    estimate = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(2 * cores) if estimate < small_bytes else df
