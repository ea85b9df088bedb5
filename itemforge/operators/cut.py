"""Plans cut by tables in the folder that the whole cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Most bytes of rows, not of files, of a table that may be broadcast.
BROADCAST = 4 << 20
#: Guessed bytes of a text and entries of an array or map.
TEXT_BYTES, ENTRIES = 32, 8
_OWN: dict[str, str] = {}
_LOCK = threading.Lock()
#: Paths of the innermost scope of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


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


def row_bytes(kind: DataType) -> int:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, StructType):
        return 8 + sum(8 + row_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return 16 + ENTRIES * row_bytes(kind.elementType)
    if isinstance(kind, MapType):
        return 32 + ENTRIES * (row_bytes(kind.keyType) + row_bytes(kind.valueType))
    return TEXT_BYTES if isinstance(kind, StringType) else 8


def merged(df: DataFrame) -> DataFrame:
    """df, whose joins sort and merge. Sizes are guessed from files, which can be a hundredth of their rows; what is broadcast for that passes the driver."""
    return df.hint("merge")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: what reads it several times computes it once, and its plan is a scan.

    Rows are counted as they are written; a table of more than BROADCAST bytes of them is never broadcast.
    The table goes at the end of the scope that it is made in; outside of any, it stays, as the result may be read at any time.
    """
    path = f"{shared_dir(df.sparkSession)}/itemforge/{name}-{uuid.uuid4().hex}"
    own = _SCOPE.get()
    if own is not None:
        own.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return merged(table) if seen.get["n"] * row_bytes(df.schema) > BROADCAST else table


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread cuts inside are deleted at the end; results that read them must be written before."""
    own: list[str] = []
    token = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
