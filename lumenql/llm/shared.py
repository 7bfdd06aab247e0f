"""Lineage cuts and packed exchanges that every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[tempfile.TemporaryDirectory] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one if that is unset on a local master."""
    conf = spark.sparkContext.getConf()
    if where := conf.get("spark.checkpoint.dir"):
        return where.rstrip("/")
    if not conf.get("spark.master", "").startswith("local") or "cluster" in conf.get("spark.master", ""):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.TemporaryDirectory(prefix="lumenql-"))
    return f"file://{_local[0].name}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenql_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="lumenql-")) / "lumenql_package.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(where))
    sc._lumenql_shipped = True


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it again: short lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenql-{name}-{uuid.uuid4().hex}"
    # what this write shuffled goes when it is done, so that disks hold one step of an operator at a time
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    writer = df.write.option("compression", "zstd" if name.startswith("z") else "lz4")
    spark.conf.set(cleanup, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    trimmed(spark)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._lumenql_path = path  # type: ignore[attr-defined]
    return back


def trimmed(spark: SparkSession) -> None:
    """Gives what the driver's JVM has freed outside its heap back to the system, if the JVM can.

    Compiling the code of some hundred plans leaves malloc with a quarter of a GB of free blocks, in an arena for each thread."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    named = jvm.java.lang.Class.forName
    kinds = new_array(jvm.java.lang.Class, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    given = new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # the server's class isn't exported, its interface is
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JJavaError:  # not HotSpot 17.0.9 or later on glibc
        return


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """How many tables saved() has written so far."""
    return len(_written)


def dropped_since(since: int, but: DataFrame) -> None:
    """Deletes the tables written after mark(), all but one."""
    keep = getattr(but, "_lumenql_path", None)
    for spark, path in _written[since:]:
        if path != keep:
            _remove(spark, path)
    _written[since:] = [x for x in _written[since:] if x[1] == keep]


def _sweep() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; a local folder goes with its TemporaryDirectory
            return


#: Bits of the largest filter of parted(): 2 MB, whatever the corpus.
_FILTER_BITS = 1 << 24


def parted(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of `docs` whose `key` surely isn't in `ids`, the other rows), by a Bloom filter of `ids`.

    Both have a long column `key`; docs has no column _bits.  Only the other rows need a join with `ids`, so what is sure isn't
    shuffled.  The filter has about 16 bits for each id up to 2 MB, which a million ids fill; with more, more rows are unsure."""
    bits = min(_FILTER_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    places = lambda: [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(3)]
    set_ = ids.select(F.explode(F.array(*places())).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at & 63))").alias("bit"))
    words = docs.sparkSession.range(bits >> 6).join(set_.groupBy("word").agg(F.bit_or("bit").alias("w")), F.col("id") == F.col("word"), "left")
    one = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("_bits"))
    beside = docs.crossJoin(F.broadcast(saved(one, "zbits")))
    maybe = F.lit(True)
    for at in places():
        bit = F.lit(1).cast("long").bitwiseAND(F.call_function("shiftright", F.get("_bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")))
        maybe = maybe & (bit == 1)
    return beside.where(~maybe).drop("_bits"), beside.where(maybe).drop("_bits")


def bounded_buckets(total_bytes: int, each: int, least: int = 12) -> int:
    """How many buckets keep one at `each` bytes when hashes deal `total_bytes` out."""
    return max(least, -(-total_bytes // each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one narrow aggregate that sizes the exchanges to come."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")).first()[0]


_FAN = 256


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(len(table.column("counts")[0].as_buffer()) // 8, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"key": table.column("key")[:1].combine_chunks(), "turn": table.column("turn")[:1].combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})


def summed(counts: DataFrame, kind: str) -> DataFrame:
    """(key, counts) from (key: `kind`, counts: 64-bit integers as bytes): element by element, in a tree of which each group has about 256 rows."""
    most = counts.groupBy("key").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    counts = counts.withColumn("turn", F.lit(0).cast("long"))
    while most > _FAN:
        most = -(-most // _FAN)
        dealt_out = counts.withColumn("turn", F.floor(F.rand(most) * F.lit(most)).cast("long"))
        counts = saved(dealt_out.groupBy("key", "turn").applyInArrow(_add, f"key {kind}, turn long, counts binary"), "zcounts")
    return counts.withColumn("turn", F.lit(0).cast("long")).groupBy("key", "turn").applyInArrow(_add, f"key {kind}, turn long, counts binary").select("key", "counts")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, one after the other; unpack() needs their types."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes | memoryview, *dtypes: str) -> list[np.ndarray]:
    sizes = [np.dtype(d).itemsize for d in dtypes]
    n, out, at = len(blob) // sum(sizes), [], 0
    for d, s in zip(dtypes, sizes, strict=True):
        out.append(np.frombuffer(blob, d, n, at))
        at += n * s
    return out


def unpack_all(column: pa.ChunkedArray, *dtypes: str) -> tuple[list[np.ndarray], np.ndarray]:
    """All rows' arrays joined, and each element's row."""
    parts = [unpack(x.as_buffer(), *dtypes) for x in column]
    joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, d) for i, d in enumerate(dtypes)]
    return joined, np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])


def dealt(keys: np.ndarray, buckets: int, *arrays: np.ndarray):
    """Yields (bucket, packed arrays) for the rows whose key falls into each bucket."""
    of = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(buckets + 1))
    arrays = tuple(a[order] for a in arrays)
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), pack(*(a[cut[b] : cut[b + 1]] for a in arrays))
