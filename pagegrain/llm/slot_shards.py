"""Sharding by fixed virtual slots, with DataFrame and SQL functions alone.

Records hash into thousands of slots that never change. Bytes are summed for each slot, and a versioned table maps slots
to shards; rebalancing edits that table and moves whole slots, never single records.

A record's slot is a hash of its doc_id, the checksum and the size of its text. A row that is repeated so often that its copies
outweigh a mean slot would fill one slot and with it one shard; the copies of such a row are numbered, and the number goes into
the hash. There are fewer such rows than slots, so their list is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrain.runtime import shared_folder

SLOTS, SHARDS = 8192, 16
#: Slots with more than so many mean slots of bytes are looked into for rows that are repeated too often.
HEAVY = 2


def record_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, and a number that tells rows apart; null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("copy"))


def slot_of(slots: int, copy: Column | None = None) -> Column:
    """The virtual slot of a record: the first 32 bits of an MD5 over what names it, and the copy's number if it has one."""
    name = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.col("size").cast("string")]
    hashed = F.md5(F.concat_ws("|", *name, *([] if copy is None else [copy.cast("string")])).cast("binary"))
    return F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def with_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` (of ``record_rows``, as a table: its numbers mustn't change from one reading to the next) with their vslot."""
    placed = rows.withColumn("vslot", slot_of(slots))
    sums = slot_bytes(placed)
    mean = (sums.agg(F.sum("bytes")).first()[0] or 0) / slots
    heavy = [r.vslot for r in sums.filter(F.col("bytes") > HEAVY * mean).select("vslot").collect()]  # less than half of the slots
    if not heavy:
        return placed
    keys = ["doc_id", "text_crc32", "size"]
    often = placed.filter(F.col("vslot").isin(heavy)).groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("bytes") > mean))
    # their bytes are more than a mean slot each, so there are fewer than slots
    often = F.broadcast(often.select(*(F.col(k).alias(f"o_{k}") for k in keys)))
    same = (F.col("doc_id").eqNullSafe(F.col("o_doc_id"))) & (F.col("text_crc32") == F.col("o_text_crc32")) & (F.col("size") == F.col("o_size"))
    marked = placed.join(often, same, "left")
    return marked.withColumn("vslot", F.when(F.col("o_size").isNotNull(), slot_of(slots, F.col("copy"))).otherwise(F.col("vslot"))).select(*rows.columns, "vslot")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; partial sums are made before the shuffle, so a hot key moves one row a task."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def _assign(sizes: Column, shards: int) -> Column:
    """The largest slot first, each to the shard with the fewest bytes; sizes: array of (vslot, bytes), largest first."""
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("map"))

    def step(acc: Column, x: Column) -> Column:
        shard = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == shard, v + x["bytes"]).otherwise(v))
        return F.struct(load.alias("load"), F.array_append(acc["map"], F.struct(x["vslot"].alias("vslot"), shard.alias("shard"))).alias("map"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["map"])


def first_map(sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: vslot, shard, version. The table has a row for each slot, so its size is bounded."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))), lambda x: F.struct(x["vslot"].alias("vslot"), (-x["less"]).alias("bytes")))
    return sums.agg(ordered.alias("sizes")).select(F.explode(_assign(F.col("sizes"), shards)).alias("m")).select("m.vslot", "m.shard", F.lit(1).alias("version"))


def rebalance_map(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards, moving as few bytes as whole slots allow.

    Each shard keeps its slots in slot order up to the new mean; the slots beyond it, and those of shards that are no
    more, go one by one (the largest first) to the shard with the fewest bytes. Slots without bytes weigh nothing.
    """
    sized = current.join(F.broadcast(sums.select("vslot", "bytes")), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))  # a row for each slot
    total, version = sized.agg(F.sum("bytes"), F.max("version")).first()
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy("vslot"))
    marked = sized.withColumn("stays", (F.col("shard") < shards) & (run <= (total or 0) / shards))
    had = {r.shard: r.load for r in marked.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("load")).collect()}  # a row for each shard
    zero = F.struct(F.array(*[F.lit(int(had.get(i, 0))).cast("long") for i in range(shards)]).alias("load"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("map"))

    def step(acc: Column, x: Column) -> Column:
        shard = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == shard, v - x["less"]).otherwise(v))
        return F.struct(load.alias("load"), F.array_append(acc["map"], F.struct(x["vslot"].alias("vslot"), shard.alias("shard"))).alias("map"))

    moving = marked.filter(~F.col("stays")).agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("moving"))
    moved = moving.select(F.explode(F.aggregate("moving", zero, step, lambda acc: acc["map"])).alias("m")).select("m.vslot", "m.shard")
    return marked.filter("stays").select("vslot", "shard").unionByName(moved).withColumn("version", F.lit((version or 0) + 1))


class SlotMaps:
    """Versions of a map in a folder: version=1, version=2 and so on, each a table (vslot, shard)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, slot_map: DataFrame, version: int) -> DataFrame:
        """Store a new version; one that exists already is never overwritten."""
        slot_map.select("vslot", "shard").coalesce(1).write.parquet(f"{self.folder}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/version={version}").select("vslot", "shard", F.lit(version).alias("version"))

    def rebalance(self, version: int, sums: DataFrame, shards: int) -> DataFrame:
        """Edit a version for new sums or another number of shards, and store it as the next one."""
        return self.write(rebalance_map(self.read(version), sums, shards), version + 1)


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the row's place in its shard, gapless from 0), grown_shard.

    The law is `bytes`: sizes of shards are near equal. Texts are read once; what follows works on a table of a few numbers a row.
    Rows are numbered inside their virtual slot, and each slot begins where the slots before it in its shard end, so no task
    holds a whole shard. Null texts have size 1, as empty ones, and null ids hash by their text. A repeated row has a place for
    each time; ties (equal id, checksum and size) are placed in any order. A very long text outweighs its shard if it alone is
    larger than the mean. Columns besides doc_id and text are ignored whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "slot-map")
    record_rows(docs).write.parquet(f"{folder}/records")
    with_slots(spark.read.parquet(f"{folder}/records"), slots).drop("copy").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    slot_bytes(rows).coalesce(1).write.parquet(f"{folder}/sums")
    sums = spark.read.parquet(f"{folder}/sums")
    slot_map = SlotMaps(spark, f"{folder}/maps").write(first_map(sums, shards), 1).select("vslot", "shard")
    # a row for each slot: both tables are bounded by the number of slots
    base = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    placed = slot_map.join(sums, "vslot").select("vslot", "shard", F.coalesce(base, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(placed), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
