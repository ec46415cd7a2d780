"""What the operators share: the cluster's shared folder, row keys, word patterns, size checks."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII-blank separated words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a broadcast table may have; beyond it a shuffled join is used.
BROADCAST_ROWS = 100_000
#: Rows that a key must have at least to be joined by broadcast in a join that splits by key.
HEAVY_ROWS = 1000
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may go without one: it gets a temporary folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; other data frames are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if its counted rows allow it, else as it is (shuffled join, AQE splits skew)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def split_join(rows: DataFrame, table: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """rows joined with the table, which has each key once and in `size` the number of its rows. Keys with so many
    rows that only few such can exist are broadcast, so that no task gets all rows of one; the others are shuffled."""
    limit = max(HEAVY_ROWS, (table.agg(F.sum(size)).first()[0] or 0) // BROADCAST_ROWS)
    heavy = F.broadcast(table.where(F.col(size) > limit))  # at most BROADCAST_ROWS rows
    names = [c for c in rows.columns if c != key] + [c for c in table.columns if c != key]
    light = rows.join(heavy, key, "left_anti").join(table.where(F.col(size) <= limit), key, how)
    return rows.join(heavy, key).select(key, *names).union(light.select(key, *names))


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; a null is no empty text."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text))


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under the given new names, so that other columns can't clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under the names c0, c1, ..., which no internal name clashes with, and the new name of each column."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new, strict=True))
