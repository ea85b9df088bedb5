"""Cutting lineage: intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import pickle
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
_LOCK = threading.Lock()
#: Most bytes of rows, not of files, of a table that may be broadcast, and the bytes guessed for a text, array or blob.
BROADCAST, LONG_BYTES = 4 << 20, 64
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the innermost scope of this thread; outside of any scope nobody deletes a table.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)
#: Settings held just now: how many hold them, and the value before.
_HELD: dict[tuple[str, str], tuple[int, str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="itemforge-")
        return _OWN[app]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting while the block runs. Blocks of several threads may overlap: the last one to end restores it."""
    at = (spark._jsparkSession.sessionUUID(), key)
    with _LOCK:
        n, before = _HELD.get(at, (0, None))
        _HELD[at] = (n + 1, before if n else spark.conf.get(key, None))
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _HELD.pop(at)
            if n > 1:
                _HELD[at] = (n - 1, before)
            else:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str, scope: list[str] | None = None) -> str:
    """A path in the shared folder that nothing else uses; the scope (the innermost one if none is given) deletes it at its end."""
    path = f"{shared_dir(spark)}/itemforge/{name}-{uuid.uuid4().hex}"
    owner = _SCOPE.get() if scope is None else scope
    if owner is not None:
        owner.append(path)
    return path


def row_bytes(schema: StructType) -> int:
    """About how many bytes a row takes in memory."""
    return 8 + sum(8 if f.dataType.simpleString() in ("boolean", "int", "bigint", "float", "double") else LONG_BYTES for f in schema)


def materialise(df: DataFrame, name: str, scope: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor costs no recomputation.

    Sizes are guessed from files, which are much smaller than rows of ids and labels; what is broadcast for that passes the
    driver. So rows are counted as they are written, and joins with a table of more than BROADCAST bytes of them sort and merge.
    """
    spark = df.sparkSession
    path = new_path(spark, name, scope)
    with setting(spark, _CLEANUP, "true"):  # what was shuffled for a table is of no use once it is written
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if seen.get["n"] * row_bytes(df.schema) > BROADCAST else table


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more; the list is empty afterwards."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while paths:
        at = jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables made inside, by this thread, are deleted at the end, and no others.

    Gives the scope around it, for tables that must outlive this one; where there is none, nobody deletes those.
    """
    outer, own = _SCOPE.get(), []
    token = _SCOPE.set(own)
    try:
        yield [] if outer is None else outer
    finally:
        _SCOPE.reset(token)
        delete(spark, own)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives value on any executor; its classes travel by value, as the executors have no copy of this package."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)
