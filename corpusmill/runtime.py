"""Session helpers: shared folder for lineage cuts, size checks before broadcasting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: A side is only broadcast by hand when it is proven to be below this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 * 2**20


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whatever the scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The application's part of the cluster's shared folder, which ``spark.checkpoint.dir`` names; removed when the driver ends.

    Where that is unset a session on one machine takes a temporary folder; on a cluster it is an error, as executors could
    not read what others wrote.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", known)
    folder = f"{known.rstrip('/')}/corpusmill-{spark.sparkContext.applicationId}"
    fs, at = _path(spark, folder)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return folder


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file's contents; None if there is none."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file that appears whole under its name, in place of one that is there."""
    fs, at = _path(spark, path)
    _, part = _path(spark, f"{path}.{uuid.uuid4().hex[:8]}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(data))
        stream.hflush()
    finally:
        stream.close()
    replace = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = replace
    context.rename(context.makeQualified(part), context.makeQualified(at), options)


def create_bytes(spark: SparkSession, path: str, data: bytes) -> bool:
    """A small file that is new; False, and nothing done, if there is one of that name. It is decided in one step who makes it."""
    fs, at = _path(spark, path)
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        stream.write(bytearray(data))
        stream.hflush()
    finally:
        stream.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, at = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def cut(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, so that its lineage ends there.

    The written table survives the loss of executors, and being columnar it can be read in parts; ``by`` names columns of
    whose values each gets a folder, so that the rows of one can be read alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def dispose(*tables: DataFrame) -> None:
    """Removes the tables that ``cut`` wrote for these, which nothing to come will read."""
    for df in tables:
        if at := getattr(df, "_cut_at", None):
            fs, path = _path(df.sparkSession, at)
            fs.delete(path, True)


def row_bytes(value: Column, kind: S.DataType) -> Column:
    """About the bytes of a value in memory; 0 for null."""
    if isinstance(kind, (S.StringType, S.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, S.ArrayType):
        if isinstance(kind.elementType, (S.StringType, S.BinaryType, S.ArrayType, S.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + row_bytes(x, kind.elementType)), F.lit(0)) + 16
        return F.coalesce(F.when(value.isNotNull(), F.size(value)), F.lit(0)) * 8 + 16
    if isinstance(kind, S.StructType):
        return sum((row_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(16)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of ``size`` bytes in all, else unchanged (a shuffle join follows).

    Only the rows' sizes are looked at, and no more than ``rows`` + 1 of them.
    """
    bytes_ = sum((row_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")
    n, b = df.select(bytes_.alias("b")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and b <= size else df


def together(*made: Callable[[], DataFrame]) -> list[DataFrame]:
    """Tables that are made independently of each other, at the same time: their jobs share the cores."""
    with ThreadPoolExecutor(len(made)) as pool:
        return [f.result() for f in [pool.submit(m) for m in made]]


def once(df: DataFrame, key: str) -> DataFrame:
    """Each key once. Only the rows of keys that come again are shuffled, by a first look at the keys alone."""
    again = small(cut(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)))
    return df.join(again, key, "left_anti").unionByName(df.join(again, key, "left_semi").dropDuplicates([key]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than half the cores, dealt over all cores; any other scan as it is.

    Work on texts is long for its bytes, so a table of one small file would be worked by one core. Only for plain scans.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
