"""Session, shared folder and table reading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_evidlake_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="evidlake-")) / "evidlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"evidlake/{f.relative_to(root)}")
    sc.addPyFile(str(target))  # served by the driver
    sc._evidlake_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        set_now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_now.isDefined():
            return set_now.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="evidlake-")  # tests and local benches
        spark.sparkContext.setCheckpointDir(own)
        return own
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """An existing path of an intermediate table is removed when the driver's JVM ends."""
    p, fs = file_system(spark, path)
    fs.deleteOnExit(p)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p), fs


def put_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """Puts a small file in place as a whole, unless there is one: of several writers exactly one gets True."""
    p, fs = file_system(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":  # whose rename may replace what is there
        staged = f"{p.getParent().toUri().getPath()}/.{uuid.uuid4().hex}"
        with open(staged, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(staged, p.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)
        return True
    hadoop = spark._jvm.org.apache.hadoop.fs
    staged = hadoop.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(data))
    out.close()
    try:
        hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, p, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception:
        if not fs.exists(p):
            raise
        fs.delete(staged, False)
        return False
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p, fs = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return spark.sparkContext.wholeTextFiles(path, 1).values().first()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and later readers survive lost executors. Gone with the driver."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with far fewer splits than cores (one small file, say), dealt to all cores before costly work on
    texts. Any input of a size that matters has enough splits and is not shuffled."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() * 3 <= want else df
