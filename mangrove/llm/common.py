"""Helpers shared by the corpus operators: shared storage, checkpoints, sizes, bounded joins."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Side tables of at most this many rows may be broadcast; beyond it joins are salted shuffles.
BROADCAST_ROWS = 50_000
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


_written: dict[str, list[str]] = {}


def _forget(spark: SparkSession, app: str) -> None:
    for path in _written.pop(app, []):
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone at exit; the folder is the cluster's scratch space
            return


def release(spark: SparkSession) -> None:
    """Deletes all tables that ``written`` made in this application.  DataFrames that read them end with them;
    long sessions call it between jobs, others leave it to the end of the driver."""
    _forget(spark, spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, and lost
    executors cost no recomputation.  The files go when the driver ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_forget, spark, app)
    path = f"{shared_dir(spark).rstrip('/')}/{app}-{name}-{uuid.uuid4().hex}"
    _written[app].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run):
    """Makes a Python worker give freed memory back to the system once a partition ends; workers are kept for
    later stages, which would add theirs to it."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return tidied


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; null counts 0.  Runs shrink to one mark each, so no array of words is built."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), WHITE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt to all cores where its files give fewer partitions than there are cores (a table in one
    small file); a scan of more partitions is left alone, so no large table is shuffled for this."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a like name that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All of a row as one struct ``_row`` beside the given columns, so that no extra column of ``df`` can clash
    with working columns; ``select("_row.*")`` unpacks it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(k) for k, c in columns.items()])


def attach(rows: DataFrame, side: DataFrame, key: str, salt: Column, side_rows: int, how: str = "inner") -> DataFrame:
    """Joins ``rows`` to ``side`` (one row per ``key``, null a key too).

    ``side`` is broadcast only if its counted rows are at most BROADCAST_ROWS.  Beyond that both sides are
    salted, so a key with a third of all rows is spread over SALTS partitions.
    """
    if side_rows <= BROADCAST_ROWS:
        side = F.broadcast(side.withColumnRenamed(key, "_key"))
        return rows.join(side, rows[key].eqNullSafe(side["_key"]), how).drop("_key")
    salted = side.withColumnRenamed(key, "_key").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    out = rows.join(salted, rows[key].eqNullSafe(salted["_key"]) & (rows["_salt"] == salted["_salt2"]), how)
    return out.drop("_key", "_salt", "_salt2")
