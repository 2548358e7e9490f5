"""Session defaults and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app: str = "orderflow", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """For queries started from here on; one that resumes keeps the store of its checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKSDB_PROVIDER)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    A local master without that setting gets a temporary folder; a cluster without it is an error,
    because a folder on one machine is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="orderflow-")


_open = threading.local()  # a micro-batch runs in a thread of its own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, one per run. It belongs to the innermost open scope."""
    path = f"{shared_dir(spark)}/orderflow/{label}-{uuid.uuid4().hex[:12]}"
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(path)
    return path


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged inside. A caller that reads a query's result to its end wraps the query in a
    scope; a frame that is still read later must not be."""
    _open.scopes = [*getattr(_open, "scopes", []), []]
    try:
        yield
    finally:
        for path in _open.scopes.pop():
            delete_path(spark, path)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: later steps read the columns they need, and lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    system, target = _file_system(spark, path)
    return [status.getPath().getName() for status in system.listStatus(target)] if system.exists(target) else []


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """List files in about four tasks a core while the block runs: by default each path is a task of its own, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(max(32, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    system, target = _file_system(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small text file appear at once and whole, unless there is one: of several that try, one gets True. Rests on the file system's rename
    without overwriting, as the checkpoints of streaming queries do."""
    system, target = _file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
    system.mkdirs(draft.getParent())
    stream = system.create(draft, True)
    stream.write(text.encode())
    stream.close()
    files = spark._jvm.org.apache.hadoop.fs
    context = files.FileContext.getFileContext(system.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), no_options)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        system.delete(draft, False)
        return False
