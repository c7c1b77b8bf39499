"""Tables in the folder that driver and executors share, and text helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Bytes of rows that a Python task is handed at once, in place of 10,000 rows of any size.
HANDED = 4 << 20

#: ASCII white space as the operators' word definition has it.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: dict[str, str] = {}
_notes = threading.local()


@contextmanager
def noted(tables: list[DataFrame]) -> Iterator[None]:
    """Tables that :func:`save` writes meanwhile, in this thread, are added to the list."""
    held = _notes.__dict__.setdefault("held", [])
    held.append(tables)
    try:
        yield
    finally:
        held.pop()


def root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder for a
    local master, and a folder of the (shared) warehouse for any other."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        if spark.sparkContext.master.startswith("local["):
            _own_root[app] = tempfile.mkdtemp(prefix="quirelight-")
        else:
            _own_root[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quirelight"
    return _own_root[app]


@contextmanager
def _as_written(spark: SparkSession) -> Iterator[None]:
    """A job's shuffle files go when it ends, not when the driver happens to collect its garbage: what it
    has written is read from the table. Its Python tasks are handed rows by their bytes."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(HANDED)}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def save(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, a lost
    executor costs nothing that was written, and later uses don't compute df again. The files
    go when the session's JVM ends, or by :func:`drop`. codec: a Parquet compression in place of
    the session's."""
    spark = df.sparkSession
    path = f"{root(spark).rstrip('/')}/quirelight/{name}-{uuid.uuid4().hex}"
    with _as_written(spark):
        df.write.parquet(path, compression=codec)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirelight_path = path
    for tables in _notes.__dict__.get("held", []):
        tables.append(out)
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that :func:`save` wrote and that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quirelight_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ranked(df: DataFrame, keys: list[str], name: str, rank: str = "rank") -> DataFrame:
    """df with the column rank (long, from 0): its place in the order of keys, over all rows.

    Rows are dealt by range, numbered within their range, and moved on by the count of the
    ranges before. The ranges are written before they are counted, so both steps see the same
    ones. Equal rows may swap places. keys should end in a column that splits ties."""
    part, at, n, before_ = "__ql_part", "__ql_at", "__ql_n", "__ql_before"
    dealt = df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id())
    dealt = save(dealt, name)
    counts = dealt.groupBy(part).agg(F.count("*").alias(n))
    # One row for each range: as many as partitions, whatever the input.
    before = F.sum(n).over(_window(None, [part]).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(part, F.coalesce(before, F.lit(0)).alias(before_))
    row = F.row_number().over(_window([part], keys))
    return (
        dealt.withColumn(at, row)
        .join(F.broadcast(starts), part)
        .withColumn(rank, (F.col(at) - 1 + F.col(before_)).cast("long"))
        .drop(part, at, n, before_)
    )


def ranked_in(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with ``rank`` (long, from 0): its place in the order, within its group.

    As :func:`ranked`: rows are dealt by range of (group, order), so that a large group lies in
    many ranges, and the ranges are written before they are counted. The group's columns must
    not be null."""
    part = "__ql_part"
    dealt = save(df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()), name)
    # A row for each group and range in which it has rows: groups + ranges at most.
    counts = dealt.groupBy(*group, part).agg(F.count("*").alias("__ql_n"))
    earlier = _window(group, [part]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, part, F.coalesce(F.sum("__ql_n").over(earlier), F.lit(0)).alias("__ql_before"))
    numbered = dealt.withColumn("__ql_at", F.row_number().over(_window([*group, part], order)))
    numbered = numbered.join(starts, [*group, part])
    rank = (F.col("__ql_at") - 1 + F.col("__ql_before")).cast("long")
    return numbered.withColumn("rank", rank).drop(part, "__ql_at", "__ql_before")


def _window(by: list[str] | None, order: list[str]) -> WindowSpec:
    return (Window.partitionBy(*by) if by else Window).orderBy(*order)
