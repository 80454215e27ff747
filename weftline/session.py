"""Session helpers: table loading, partition sizing and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

TARGET_PARTITION_BYTES = 24 << 20
MOST_PARTITIONS = 1 << 20
UNKNOWN_BYTES = 1 << 60


def session(app: str = "weftline", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the parquet tables, pruned to the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def size_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan: file sizes for scans, no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(spark: SparkSession, df: DataFrame, target: int = TARGET_PARTITION_BYTES, expand: float = 4.0) -> int:
    """A partition count that keeps one partition near `target` bytes once decoded.

    `expand` is the assumed ratio of decoded to stored bytes. Never below the session's shuffle partitions, which also
    hold where the optimizer does not know a size (rows made on the driver).
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = size_bytes(df)
    if size >= UNKNOWN_BYTES:
        return least
    return min(MOST_PARTITIONS, max(least, int(size * expand / target) + 1))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where it is unset and the master is local (tests), one is made."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete all scratch folders this process made, once their results are no longer read; how many."""
    n = len(_made)
    while _made:
        delete(spark, _made.pop())
    return n


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing a table in the shared folder and reading it back."""
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see all of it or nothing: written aside, then given its name.

    The name is given only if nobody has it (a hard link, or a rename without overwriting), so of two writers that
    publish one version the second is refused with FileExistsError.
    """
    fs, final = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    jvm = spark.sparkContext._jvm
    try:
        if fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), final.toUri().getPath())
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
            context.rename(aside, final, options)
    except Exception as e:
        if isinstance(e, FileExistsError) or fs.exists(final):
            raise FileExistsError(path) from e
        raise
    finally:
        fs.delete(aside, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    n = int(fs.getFileStatus(p).getLen())
    stream = fs.open(p)
    try:
        data = stream.readNBytes(n)
    finally:
        stream.close()
    return bytes(data).decode("utf-8")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; empty if the folder is missing."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for clusters where it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="weftline-ship-"), "weftline_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
