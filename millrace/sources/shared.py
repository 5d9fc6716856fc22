"""The folder that the driver and all executors share, and tables in it that cut lineage.

The folder is the one that ``spark.checkpoint.dir`` names; where it is unset, as
in tests, a local master gets a folder of its own.  What is made here is removed
by ``remove``, at the latest when the driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, object] = {}  # path -> the JVM that can remove it
_tables: dict[str, tuple[SparkSession, str]] = {}  # path -> the session and the name of a table that the catalogue has there


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark._jvm
    return path


def register(spark: SparkSession, path: str) -> None:
    """Have a path removed when the process ends."""
    _made[path] = spark._jvm


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove tables and folders that no frame will read again."""
    for path in paths:
        _forget(path)
        _delete(spark._jvm, path)
        _made.pop(path, None)


def _forget(path: str) -> None:
    if path in _tables:
        spark, table = _tables.pop(path)
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _delete(jvm, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for path, jvm in _made.items():
        with contextlib.suppress(Exception):  # the JVM may be gone
            _forget(path)
        with contextlib.suppress(Exception):
            _delete(jvm, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: it outlives lost executors and is read any number of times."""
    return Scratch(df.sparkSession, name).cut(df)


def materialise_tidy(df: DataFrame, name: str) -> DataFrame:
    """The same, and the shuffle files of the computation go with it."""
    return Scratch(df.sparkSession, name, True).cut(df)


#: Whether Spark removes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Writes in here remove their shuffle files at once, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Tables that are made between two times that the driver's JVM gives memory back.
SETTLE = 8
_cuts = itertools.count(1)


def settle(spark: SparkSession) -> None:
    """The driver's JVM gives back what its heap and its C library hold free: plans of many stages leave both behind, and neither shrinks by itself."""
    with contextlib.suppress(Exception):  # another JVM or C library may not offer it
        jvm = spark._jvm
        jvm.System.gc()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class is closed to reflection
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


class Scratch:
    """Tables of one computation; ``drop`` removes those that its result does not read.  ``clean``: shuffle files go when a table is made."""

    def __init__(self, spark: SparkSession, name: str, clean: bool = False) -> None:
        self.spark, self.name, self.clean, self.paths = spark, name, clean, {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, self.name)
        with tidy(self.spark) if self.clean else contextlib.nullcontext():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        if next(_cuts) % SETTLE == 0:
            settle(self.spark)
        return out

    def cut_by(self, df: DataFrame, key: str) -> DataFrame:
        """The same as a table of one sorted file for each hash of the key: a join or aggregate by the key does not shuffle it, in as many partitions as shuffles have now."""
        path, n = fresh_path(self.spark, self.name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = "millrace_" + path.rsplit("-", 1)[-1]
        with tidy(self.spark) if self.clean else contextlib.nullcontext():
            df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        self.paths[id(out)] = (path, out)
        _tables[path] = (self.spark, table)
        return out

    def drop(self, *keep: DataFrame) -> None:
        kept = {id(k) for k in keep}
        for k, (path, _) in list(self.paths.items()):
            if k not in kept:
                remove(self.spark, path)
                del self.paths[k]
