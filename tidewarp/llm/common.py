"""What the operators of this subpackage share: tables, written cuts of lineage, text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of every contract here: \x20 and \x09 to \x0D, which is also what bytes.split() splits at.
BLANK = b" \t\n\x0b\x0c\r"

#: Keys that join_hot() broadcasts are fewer than this.
HOT_KEYS = 1000

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}
#: In a Python worker: how to forget what the tasks of an operator remember from one to the next.
_remembered: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local-mode session without that setting (as in tests) gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="tidewarp-")
    return _local_dirs[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/tidewarp/{what}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete what cut() and scratch() of this session wrote; frames that read it can't be used afterwards."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _written.pop(spark.sparkContext.applicationId, []):
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The written table ends the lineage (a lost executor costs no recomputation beyond it), is read any
    number of times, and gives later plans true sizes to choose joins by.
    """
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int, scatter: str, how: str = "inner") -> DataFrame:
    """Inner (or left) join of rows with side, which has one row a key and tells by ``weight`` how many rows hold it, of ``total``.

    Keys that hold more than a thousandth of the rows are fewer than HOT_KEYS, whatever the input, and are
    broadcast; their rows are dealt to the join's tasks by a hash of the column ``scatter``, so no task receives a key's rows.
    """
    others = [c for c in side.columns if c != key]
    heavy = F.col(weight) > max(1, total // HOT_KEYS)
    hot = side.where(heavy).select(F.col(key).alias("__tw_hot"), *(F.col(c).alias(f"__tw_hot_{c}") for c in others))
    cold = side.where(~heavy).select(F.col(key).alias("__tw_cold"), *(F.col(c).alias(f"__tw_cold_{c}") for c in others))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__tw_hot"), "left")
    kind = rows.schema[key].dataType
    scattered = F.xxhash64(scatter, F.lit("hot"))
    scattered = scattered if kind.typeName() in ("bigint", "long") else scattered.cast("string").cast(kind)
    marked = marked.withColumn("__tw_key", F.when(F.col("__tw_hot").isNull(), F.col(key)).otherwise(scattered))
    joined = marked.join(cold, F.col("__tw_key") == F.col("__tw_cold"), "left")
    if how == "inner":
        joined = joined.where("__tw_hot IS NOT NULL OR __tw_cold IS NOT NULL")
    found = (F.when(F.col("__tw_hot").isNotNull(), F.col(f"__tw_hot_{c}")).otherwise(F.col(f"__tw_cold_{c}")).alias(c) for c in others)
    return joined.select(*rows.columns, *found)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII rows take the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_bits(key: Column, bits: int = 60) -> Column:
    """The first bits (a multiple of 4, at most 60) of md5(key as text) as a long; null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("long")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes, null as b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def remember(owner: str, forget: Callable[[], None]) -> None:
    """For tasks that leave something to the worker's next ones: drops what other operators left."""
    drop_others(owner)
    _remembered[owner] = forget


def drop_others(owner: str) -> None:
    """A Python worker serves the tasks of many stages, in turn; what another operator's tasks remembered in it is forgotten, and what Arrow holds unused is given back."""
    for other in [x for x in _remembered if x != owner]:
        _remembered.pop(other)()
    pa.default_memory_pool().release_unused()


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | list | None]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function from one that maps a single batch."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return run
