"""Shards of equal bytes by sampled splitters.

A size-weighted key sample gives quantile boundaries; records are range-partitioned by them, ranges with
too many rows are subdivided by a hash, and cumulated bytes over (range, part, row) cut the shards. The
key is the text's hash in its upper bits and the id's hash in its lower 24, so that equal texts lie
together and a group with a third of all rows still has many boundaries. Only a narrow table without
texts is shuffled; no window spans more than one part of a range. Everything depends on the rows alone:
the same rows in other files or partitions get the same shards and slots.

Awkward rows: null texts have size 1, empty ones too; a very long text is one record, so a shard may hold more than
its part by one record's size; null ids are placed like any other; ties of the key go by id, checksum and size; rows
repeated in full are counted first, placed as one run, and written out again at the end, in blocks. An empty table
gives an empty result; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize

UNIT = float(2**63)


def shard_by_bytes(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 8, rows_per_part: int = 20_000, sample_per_range: int = 200, block: int = 10_000) -> DataFrame:
    """``docs`` (doc_id, text, ...) to doc_id, size, text_crc32, law, shard, slot, grown_shard, range, part, key."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftleft(F.shiftright(F.xxhash64(text), 24), 24).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(0xFFFFFF))).alias("key"),
    )
    narrow = materialize(each.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("times")), "shard-keys")
    weight = F.col("size") * F.col("times")
    n_bytes = narrow.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    ranges = shards * ranges_per_shard
    # A row is drawn with a chance in proportion to its bytes; the draw is a hash, so a repeated task draws the same.
    chance = F.abs(F.xxhash64("key", F.lit("draw")).cast("double")) / UNIT
    sample = narrow.where(chance < weight * (ranges * sample_per_range / max(1, n_bytes))).agg(F.sort_array(F.collect_list("key"))).first()[0]
    splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    placed = narrow.withColumn("range", F.size(F.filter(F.array(*map(F.lit, splitters)).cast("array<bigint>"), lambda x: x <= F.col("key"))))
    full = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row a range
    parts = [-(-full.get(i, 0) // rows_per_part) or 1 for i in range(len(splitters) + 1)]
    n_parts = F.element_at(F.array(*map(F.lit, parts)), F.col("range") + 1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key", F.lit("part")), n_parts).cast("int"))

    cells = placed.groupBy("range", "part").agg(F.sum("times").alias("n"), F.sum(weight).alias("b"))
    inside = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = cells.select("range", "part", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"part_{c}") for c in ("n", "b")])
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy("range").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).select("range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"range_{c}") for c in ("n", "b")])
    starts = within.join(before, "range").select("range", "part", (F.col("part_n") + F.col("range_n")).alias("first_n"), (F.col("part_b") + F.col("range_b")).alias("first_b"))
    order = Window.partitionBy("range", "part").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        placed.join(starts, ["range", "part"])
        .withColumn("at", F.col("first_n") + F.sum("times").over(order) - F.col("times"))
        .withColumn("ahead", F.col("first_b") + F.sum(weight).over(order) - weight)
        .select("doc_id", "size", "text_crc32", "times", "at", "ahead", "range", "part", "key")
    )
    runs = materialize(runs, "shard-runs")
    # Rows repeated in full: their run in blocks, dealt anew, then row by row.
    again = runs.where("times > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(block))).alias("lo")).repartition("doc_id", "key", "lo")
    again = again.select("*", F.explode(F.sequence("lo", F.least(F.col("lo") + block, F.col("times")) - 1)).alias("turn")).drop("lo")
    rows = runs.where("times = 1").withColumn("turn", F.lit(0).cast("long")).unionByName(again)
    at, bytes_ahead = F.col("at") + F.col("turn"), F.col("ahead") + F.col("turn") * F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(bytes_ahead * F.lit(shards) / F.lit(max(1, n_bytes)))).cast("int")
    rows = materialize(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), at.alias("at"), "range", "part", "key"), "shard-rows")
    first = {r["shard"]: r["at"] for r in rows.groupBy("shard").agg(F.min("at").alias("at")).collect()}  # one row a shard
    base = F.element_at(F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(shards)]), F.col("shard") + 1)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - base).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "range", "part", "key"
    )
