"""Spark plumbing that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder; only Spark's own readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local one only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="flowgrain-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them back.

    A later loss of an executor cannot lose them, and every later use sees the same rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy_driver(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._flowgrain_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` or :func:`bucketed` wrote, once no later plan reads it."""
    for df in frames:
        spark = df.sparkSession
        if getattr(df, "_flowgrain_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df._flowgrain_table}")
        path = getattr(df, "_flowgrain_path", None)
        if path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def bucketed(df: DataFrame, path: str, buckets: int, *keys: str) -> DataFrame:
    """Write the rows under ``path``, bucketed and sorted by ``keys``: joins on them with equally many buckets need no shuffle."""
    name = f"flowgrain_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return _table(df.sparkSession, name, path)


def open_bucketed(spark: SparkSession, schema: str, path: str, buckets: int, *keys: str) -> DataFrame:
    """A frame over what :func:`bucketed` wrote in another session."""
    name = f"flowgrain_{uuid.uuid4().hex}"
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return _table(spark, name, path)


def _table(spark: SparkSession, name: str, path: str) -> DataFrame:
    out = spark.table(name)
    out._flowgrain_table, out._flowgrain_path = name, path
    return out


#: Parts into which :func:`salted_totals` deals the rows of a group.
SALTS = 64


def salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts_of(mask: str) -> Column:
    """One row for each bit of a mask of salts."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col(mask), i) == 1))


def salted_totals(rows: DataFrame, keys: list[str], by: list[str], **aggregates) -> DataFrame:
    """(keys, mask, aggregates) of each group; each of ``aggregates`` is a pair (function that can be applied to its own results, column).

    Groups are first aggregated in up to ``SALTS`` parts by a hash of ``by``; ``mask`` has the bits of those there
    are. Joined by keys and :func:`salts_of` with rows that carry the same :func:`salt`, the totals reach the rows of a
    hot group in as many tasks, and have never more rows than the group.
    """
    part = rows.groupBy(*keys, salt(*by).alias("salt__")).agg(*(f(c).alias(n) for n, (f, c) in aggregates.items()))
    return part.groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(1L, salt__)")).alias("mask"), *(f(n).alias(n) for n, (f, _) in aggregates.items()))


#: Rows and bytes that go to Python in one Arrow batch. Texts are long: Spark's default of 10,000 rows would hold some 40 MB several times.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def python_batches(rows: DataFrame) -> DataFrame:
    """``rows``, after the session's Arrow batches were bound by rows and bytes; operators that send texts to Python begin with it."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows


def give_back() -> None:
    """Return what this process has freed to the system: a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def frugal(run: Callable) -> Callable:
    """``run``, a function of an iterator of Arrow batches, that gives its freed memory back when its task ends."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def shrink_heaps(spark: SparkSession) -> None:
    """Have every executor's JVM collect and return the heap that it has grown by: it keeps it otherwise, beside Python workers that need it.

    One short task for each core; each asks for a full collection, after which the heap shrinks to what lives.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def manage(spark: SparkSession, bean: str, operation: str, *args: str):
    """What an operation of one of the driver JVM's own management beans returns, called through a public interface."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName

    def array(kind, *items):
        out = new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    anything, string = jvm.java.lang.Object, jvm.java.lang.String
    takes = array(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    given = array(anything, jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), operation, array(anything, *args), array(string, *["java.lang.String"] * len(args)))
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    return named("javax.management.MBeanServer").getMethod("invoke", takes).invoke(server, given)


#: Seconds between two calls of :func:`tidy_driver` that do anything, share of the largest heap by which it may grow until it is collected, and percent of it that stay free then.
TIDY_EVERY, TIDY_GROWN, TIDY_FREE = 10, 0.2, "40"
_tidied = {"at": 0.0, "heap": 0}


def tidy_driver(spark: SparkSession, now: bool = False) -> None:
    """Have the driver's JVM return what it holds free: a plan of many stages leaves it a grown heap and freed native memory of its compiler and threads.

    The native memory is returned at every call, but at most once in ``TIDY_EVERY`` seconds, the heap if it has grown since it
    was last collected. With ``now`` both are, at once. JVMs without these operations keep what they hold.
    """
    if not now and time.monotonic() - _tidied["at"] < TIDY_EVERY:
        return
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if now or runtime.totalMemory() > _tidied["heap"] + TIDY_GROWN * runtime.maxMemory():
        try:
            usual = manage(spark, "HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio").get("value")
            manage(spark, "HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", TIDY_FREE)
        except Py4JError:
            usual = None
        spark._jvm.System.gc()
        if usual is not None:
            manage(spark, "HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", usual)
        _tidied["heap"] = runtime.totalMemory()
    try:
        manage(spark, "DiagnosticCommand", "systemTrimNativeHeap")
    except Py4JError:
        pass
    _tidied["at"] = time.monotonic()


def text_or_empty(column: str | Column = "text") -> Column:
    """A text column without nulls."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: 64-bit words of the bitmap of ids; with its index each has 16 bytes, so a bitmap has at most 16 MB.
WORDS = 1 << 20


def sifted(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ``ids``, rows whose id surely isn't), without a shuffle of the rows.

    The ids (one bigint column) are hashed into a bitmap of fixed size, which is broadcast with that proven
    bound; every row meets its word of the bitmap on the map side. More ids than the bitmap can tell apart only
    let more rows into the first frame. A null id surely isn't.
    """
    words = ids.toDF("id").where("id is not null").select(
        F.pmod(F.xxhash64("id"), F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, int(pmod(shiftright(xxhash64(id), 32), 64)))").alias("one")
    )
    words = F.broadcast(materialize(words.groupBy("word").agg(F.bit_or("one").alias("bits")), "bitmap"))
    # Rows travel as one struct, so that none of their names can clash.
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(column).cast("bigint").alias("key"))
    met = own.join(words, F.pmod(F.xxhash64("key"), F.lit(WORDS)) == F.col("word"), "left")
    bit = F.expr("shiftrightunsigned(bits, int(pmod(shiftright(xxhash64(key), 32), 64))) & 1") == 1
    may = F.coalesce(bit & F.col("key").isNotNull(), F.lit(False))
    return met.where(may).select("row.*"), met.where(~may).select("row.*")


def _matched(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(column).cast("bigint").alias("key"))
    return own.join(ids.toDF("id").distinct().hint("merge"), F.col("key") == F.col("id"), how).select("row.*")


def _split(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows whose id is surely among ``ids``, those where only a join can tell, those whose id surely isn't).

    Ids that the bitmap takes for some of ``ids`` are found by a join of ids alone and go into a second bitmap: few rows are in both.
    """
    may, surely_not = sifted(rows, ids, column)
    false = sifted(rows.select(F.col(column).cast("bigint").alias("id")), ids, "id")[0].distinct().join(ids.toDF("id").distinct().hint("merge"), "id", "left_anti")
    unclear, surely = sifted(may, materialize(false, "false"), column)
    return surely, unclear, surely_not


def with_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is among ``ids``; of the rows only those are shuffled that two bitmaps can't tell."""
    surely, unclear, _ = _split(rows, ids, column)
    return surely.unionByName(_matched(unclear, ids, column, "left_semi"))


def without_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids`` (null ids stay); of the rows only those are shuffled that two bitmaps can't tell."""
    _, unclear, surely_not = _split(rows, ids, column)
    return surely_not.unionByName(_matched(unclear, ids, column, "left_anti"))
