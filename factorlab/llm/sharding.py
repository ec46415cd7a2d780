"""Sharding by longest processing time: groups of equal texts, largest first, to the least-loaded shard.

A heap on the driver can't hold a group per text of a large corpus. So groups of more than a 64th of a
shard are scheduled one by one (there are at most 64 a shard), and all smaller ones in packs that a hash
of the text forms; the packs are far smaller than a shard and keep groups together as well. What the
driver schedules is bounded by parameters, whatever the number of rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Packs of small groups a shard; large groups a shard at most; rows that are numbered together.
PACKS, LARGE, RUN_ROWS = 1024, 64, 500_000
#: Columns that the result adds.
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def lpt(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Largest first, each to the shard with the least load; ties by name and shard number."""
    heap, at = [(0, i) for i in range(shards)], {}
    for n, name in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, i = heapq.heappop(heap)
        at[name] = i
        heapq.heappush(heap, (load + n, i))
    return at


def shard(docs: DataFrame, shards: int = 16, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns in `carry`, size (UTF-8 bytes + 1), text_crc32, law ('bytes'), shard,
    slot (gapless from 0 in each shard) and grown_shard (null under this law).

    Rows of equal text share a shard, however long it is; null texts are a group of their own, of size 1 each, not that of
    empty texts. A null doc_id is kept and sorts first. Repeated rows get slots of their own. An empty table
    gives no rows. Columns that aren't named are not read; a carried one with the name of an added one is left out.
    """
    spark = docs.sparkSession
    carried = {f"_c{i}": c for i, c in enumerate(carry) if c != doc_id and c not in OWN}
    named = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_t"), *(F.col(f"`{c}`").alias(k) for k, c in carried.items()))
    packs = shards * PACKS
    keyed = named.withColumns({"_g": shared.text_key(F.col("_t")), "_n": F.coalesce(F.octet_length("_t"), F.lit(0)).cast("long") + 1})
    keyed = keyed.withColumn("_p", F.pmod(F.xxhash64("_g"), F.lit(packs)).cast("int"))
    plain = shared.written(keyed.select("_id", "_g", "_n", "_p"))
    total, rows = plain.agg(F.sum("_n"), F.count("*")).first()
    groups = shared.written(plain.groupBy("_g", "_p").agg(F.sum("_n").alias("_n")))
    least = max(2, (total or 0) // (shards * LARGE))
    large = [(r["_n"], r["_g"]) for r in groups.where(F.col("_n") > least).collect()]  # at most LARGE a shard
    small = [(r["_n"], r["_p"]) for r in groups.where(F.col("_n") <= least).groupBy("_p").agg(F.sum("_n").alias("_n")).collect()]  # a row a pack
    at = lpt(large + small, shards)
    alone = spark.createDataFrame([(g, at[g]) for _, g in large], "_g string, _large int")
    packed = spark.createDataFrame([(p, at[p]) for _, p in small], "_p int, _pack int")

    runs = max(16, -(-(rows or 0) // (shards * RUN_ROWS)))

    def placed(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(alone), "_g", "left").join(F.broadcast(packed), "_p", "left")
        return df.withColumns({"_shard": F.coalesce("_large", "_pack"), "_run": F.pmod(F.xxhash64("_id", "_g"), F.lit(runs)).cast("int")})

    counts = placed(plain).groupBy("_shard", "_run").agg(F.count("*").alias("_c"))
    first = counts.withColumn("_first", F.sum("_c").over(Window.partitionBy("_shard").orderBy("_run")) - F.col("_c")).drop("_c")
    first = shared.small(shared.written(first), shards * runs)
    number = F.row_number().over(Window.partitionBy("_shard", "_run").orderBy("_id", "_g")) - 1
    done = placed(keyed).withColumn("_crc", F.crc32(F.coalesce("_t", F.lit("")))).drop("_t").withColumn("_i", number).join(first, ["_shard", "_run"])
    return done.select(
        F.col("_id").alias(doc_id),
        *(F.col(k).alias(c) for k, c in carried.items()),
        F.col("_n").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_first") + F.col("_i")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
