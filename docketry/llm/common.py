"""What the operators of this subpackage share: tables, words, scratch tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.shared import Scratch, shared_dir

__all__ = ["Scratch", "by_batch", "dealt_join", "hot_keys", "id_remainder", "shared_dir", "spread_join", "table", "words"]

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, read by Spark alone (the path may be in any store)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null ids: null)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def hot_keys(rows: DataFrame, on: str, most: int) -> list[tuple]:
    """(value, number of tasks to deal its rows to) of the values of ``on`` on more than ``most`` rows.

    There are at most count / most such values, and never over 100,000, as ``most`` grows with the count from there.
    """
    total = rows.count()
    most = max(most, total // 100_000)
    if total <= most:
        return []
    hot = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    return [tuple(r) for r in hot.select(on, F.ceil(F.col("_n") / most).cast("int")).collect()]  # at most 100,000 rows


def dealt_join(rows: DataFrame, one: DataFrame, on: str, hot: list[tuple], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``one`` (a row for each value of ``on`` at most); the rows of ``hot`` values are dealt to so many tasks each."""
    if not hot:
        return rows.join(one, on, how)
    table = F.broadcast(rows.sparkSession.createDataFrame(hot, f"`{on}` {rows.schema[on].dataType.simpleString()}, _tasks int"))
    left = rows.join(table, on, "left").withColumn("_task", F.when(F.col("_tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_tasks")).cast("int"))).drop("_tasks")
    right = one.join(table, on, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))).drop("_tasks")
    return left.join(right, [on, "_task"], how).drop("_task")


def spread_join(rows: DataFrame, one: DataFrame, on: str, most: int = 50_000, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``one`` (a row for each value of ``on`` at most), with no value's rows all in one task.

    Values on more than ``most`` rows are counted first; their row of ``one`` is repeated for so many tasks and
    their rows are dealt to these.  A null matches nothing.
    """
    return dealt_join(rows, one, on, hot_keys(rows, on, most), how)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of ``rows`` rows, unless the session asks for a number of its own.

    With the default of 10,000 whole documents a batch, its buffers, which double as they grow, and their copies in Python take some
    hundred megabytes of each executor core.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(rows))


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, rows: int = 1000) -> DataFrame:
    """``f`` over ``rows`` rows at a time (see ``small_batches``)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                if (out := f(b.slice(at, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)
