"""Shards by jump consistent hashing: a stable key and the number of shards decide, no ring table is kept.

The key's jumps are drawn from MD5 of (key, jump number), so that any engine can repeat them. When shards are
appended, a row either stays or moves into a new shard. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.common import free_names, table
from buyerscope.llm.numbering import number_rows

HEX_DIGITS = 13  # 52 bits: exact in a double


def jump_shard(key: Column, n_shards: int) -> Column:
    """Shard 0 .. n_shards - 1 of a key; a null key counts as the empty text.

    Lamping and Veach's loop: from shard ``b`` jump to floor((b + 1) / r) with r uniform in (0, 1], until the jump leaves the
    range. A jump always goes up, so ``n_shards`` steps suffice; steps after the last jump cost one comparison.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    span = float(16**HEX_DIGITS)

    def step(at: Column, k: Column) -> Column:
        digits = F.substring(F.md5(F.concat(text, F.lit(":"), k.cast("string"))), 1, HEX_DIGITS)
        drawn = F.conv(digits, 16, 10).cast("double") + 1.0
        target = F.floor((at["j"] + 1).cast("double") * F.lit(span) / drawn)
        moved = F.struct(at["j"].alias("b"), F.least(target, F.lit(n_shards).cast("long")).alias("j"))
        return F.when(at["j"] < n_shards, moved).otherwise(at)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    steps = F.sequence(F.lit(0), F.lit(n_shards))
    return F.aggregate(steps, start, step, lambda at: at["b"]).cast("int")


def assign_shards(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """``df`` with ``shard`` (replaced if there is one). Rows with equal keys share a shard; nothing is shuffled."""
    return df.withColumn("shard", jump_shard(F.col(key), n_shards))


def number_slots(df: DataFrame, key: str, tie: str) -> DataFrame:
    """``df`` (with ``shard``) and ``slot``, gapless from 0 in every shard, in the order of MD5(key, tie).

    All rows are numbered once by shard and digest, range by range, and written; a slot is the number less the shard's first number, so
    no shard is sorted in one task. Rows equal in key and tie may lie in several ranges, and their slots are interchangeable. A null
    key counts as the empty text, a null tie is left out. ``slot`` is replaced if there is one; all other columns pass unchanged.
    """
    mark, first = free_names(df, "slot_mark", "slot_first")
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(tie).cast("string")))
    numbered = number_rows(df.drop("slot").withColumn(mark, digest), [F.col("shard"), F.col(mark)], "slot").drop(mark)
    starts = numbered.groupBy("shard").agg(F.min("slot").alias(first))  # one row per shard
    return numbered.join(starts, "shard").withColumn("slot", F.col("slot") - F.col(first)).drop(first)


def write_shards(df: DataFrame, key: str, n_shards: int, path: str) -> None:
    """Write ``df`` as Parquet below ``path``, one folder ``shard=N`` per shard, through Spark's commit protocol."""
    assign_shards(df, key, n_shards).write.partitionBy("shard").parquet(path)


def op9_jump_shards(spark, folder: str, n_shards: int = 40) -> DataFrame:
    """Shard, slot and place after one more shard of every document.

    Null texts have size 16 and the checksum of the empty text; repeated rows share a shard and get slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign_shards(rows, "doc_id", n_shards).withColumn("grown_shard", jump_shard(F.col("doc_id"), n_shards + 1))
    return number_slots(placed, "doc_id", "text_crc32").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
