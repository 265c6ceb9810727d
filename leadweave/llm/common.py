"""What several operators share: the checkpoint folder, text batches, size-checked joins and the corpus id split.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D, which is how ``bytes.split()`` splits.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from math import ceil
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast, and the bytes a row of it may take at most, checked by a count.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 48 << 20
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Unset on a cluster, it is a folder below the warehouse, which is shared unless it is a local folder: then the
    setting is asked for. A temporary folder is made for a local master only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
            found = "file://" + tempfile.mkdtemp(prefix="leadweave-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_leadweave"
            if urlparse(found).scheme in ("", "file"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables written, by scope: the innermost one gets what cut() writes.
_scopes: list[list[str]] = [[]]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder, so that a lost executor costs no recomputation.

    Reading a table, plans also start from its true size. A table stays until its scope() ends, it is dropped, or the process ends.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/leadweave-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() has returned and nothing reads any more."""
    for df in tables:
        for own in _scopes:
            if df.table_path in own:
                own.remove(df.table_path)
                delete(df.sparkSession, df.table_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended, which it does once the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, so that results have to be written there; those written before stay."""
    _scopes.append(own := [])
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            delete(spark, path)


@atexit.register
def _clear_at_exit() -> None:
    if (spark := SparkSession.getActiveSession()) is not None:
        with contextlib.suppress(Exception):  # the session may have ended
            for path in [p for own in _scopes for p in own]:
                delete(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_or_shuffled(df: DataFrame, rows: int, row_bytes: Column | None = None) -> DataFrame:
    """df (already cut) with a broadcast hint if it has at most ``rows`` rows and BROADCAST_BYTES bytes.

    row_bytes gives the bytes of a row's variable part. Beyond the bound no hint is given and the
    join shuffles both sides.
    """
    size = F.sum(row_bytes + F.lit(24)) if row_bytes is not None else F.count(F.lit(1)) * 40
    n, size = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


#: Members of a bucket that one join key of bucket_pairs() has at most, about.
CHUNK = 1_000


def in_turns(spark: SparkSession, turns: int, step: Callable[[Callable[..., Column]], DataFrame]) -> DataFrame:
    """The rows of all turns of step(mine), one turn after the other and each cut, so that only what one turn shuffles is on disk at a time.

    mine(columns) tells whether it is a row's turn, by a hash of the columns.
    """
    out = []
    for k in range(turns):
        out.append(cut(step(lambda *by: F.pmod(F.xxhash64(*by, F.lit(3)), F.lit(turns)) == k)))  # noqa: B023
        release(spark)
    return reduce(DataFrame.union, out)


def bucket_pairs(rows: DataFrame, ident: str, near: Column, most: int | None = None, step: Callable[[DataFrame], DataFrame] | None = None, more: DataFrame | None = None) -> DataFrame:
    """Each two rows of one ``key`` and different ``root`` for which ``near`` holds; the columns of the other one have an o before their names.

    A bucket is cut into chunks by the hash of ``ident``, and each two chunks are a join key of their own, so that a task holds two
    chunks however large a bucket is. What is compared grows with the square of what a bucket holds of different groups. With
    ``step`` the rows are step(pairs), made in turns of about ``most`` rows to compare. ``more`` (cut) has further columns by
    ``ident``. ``rows`` and ``more`` are dropped then, as soon as they have been read.
    """
    sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "n", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    columns = [*rows.columns, *[c for c in (more.columns if more is not None else []) if c != ident]]
    wide = rows if more is None else rows.join(more, ident)
    held = cut(wide.join(small_or_shuffled(sizes.drop("n"), BROADCAST_ROWS), "key").select(*columns, "chunks", F.pmod(F.xxhash64(ident), F.col("chunks")).cast("int").alias("own")))
    if step is not None:
        drop(*[x for x in (rows, more) if x is not None])

    def met(mine: Callable[..., Column], tasks: int = 0) -> DataFrame:
        dealt = lambda side: side.where(mine("key", "i", "j")).repartition(tasks, "key", "i", "j") if tasks else side
        left = held.select(*columns, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("chunks") - 1)).alias("j"))
        right = held.select("key", F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), *[F.col(c).alias(f"o{c}") for c in columns if c != "key"])
        return dealt(left).join(dealt(right), ["key", "i", "j"]).where("root <> oroot").where((F.col("i") < F.col("j")) | (F.col(ident) < F.col(f"o{ident}"))).where(near).drop("i", "j")

    if step is None:
        return met(lambda *by: F.lit(True))
    spark = rows.sparkSession
    release(spark)
    dealt, compared = sizes.agg(F.sum(F.col("n") * (F.col("chunks") + 1)), F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()
    turns = max(1, ceil((dealt or 0) / most))
    tasks = min(2_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil((compared or 0) / turns / CHUNK**2)))
    out = in_turns(spark, turns, lambda mine: step(met(mine, tasks)))
    drop(sizes, held)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, group: str, per_group: int, key: str = "doc_id") -> DataFrame:
    """About per_group rows of each value of ``group``, by a threshold on the hash of ``key``.

    The threshold comes from the groups' counts, so that no group is gathered in one task; the
    number of rows is binomial around per_group (all of them where the group has fewer).
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).collect()
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, per_group / r[1])))])
    place = F.pmod(F.xxhash64(F.col(key), F.lit(77)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(place < F.element_at(rate, F.col(group)))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


#: Rows of an Arrow batch, where the session has the default of 10,000.
ARROW_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand Arrow batches of at most ARROW_ROWS rows to Python workers, unless the session has a setting of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each slice of an input batch of at most 8 MB of text.

    Slices bound a worker's memory whatever the lengths of texts; only single rows larger than that exceed it.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield f(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        pieces = max(1, min(batch.num_rows, ceil(batch.nbytes / limit)))
        step = ceil(batch.num_rows / pieces)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalisation of 64-bit sums, so that all bits of a rolling hash are usable."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` consecutive word hashes; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power = np.zeros(n, np.uint64), np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * power + words[k : k + n]
        return mix(out)
