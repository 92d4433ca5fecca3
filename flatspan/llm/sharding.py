"""Sharding by fixed virtual slots, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A record's slot never changes; what changes is the slot's shard.
VIRTUAL_SLOTS = 4096
#: Copies of a record that one row stands for on the way to their slots.
RUN = 4096


def virtual_slot(n_slots: int = VIRTUAL_SLOTS) -> Column:
    """The fixed slot of a record's copy, by md5 of its id, its text's checksum and, from the second copy on, its number."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat_ws(":", part("doc_id"), part("text_crc32"), F.when(F.col("copy") > 0, F.col("copy").cast("string")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % n_slots


def slot_bytes(records: DataFrame) -> DataFrame:
    """(virtual, bytes, n): what each slot holds; at most one row a slot and task is shuffled."""
    return records.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def build_slot_map(load: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """(version, virtual, shard, bytes, n) of all VIRTUAL_SLOTS: dealt by size, largest first, each to the shard that has least so far.

    load has at most one row a virtual slot (thousands), so the ordered list of all slots is a bounded value:
    it is one array, folded once. Ties go to the lower shard; slots of equal size are ordered by number. Empty slots
    are dealt in turn, so that later records find a shard in every slot.
    """
    every = load.sparkSession.range(VIRTUAL_SLOTS).select(F.col("id").alias("virtual")).join(F.broadcast(load), "virtual", "left")
    every = every.select("virtual", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    listed = every.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual", "n"))).alias("slots"))
    return (
        listed.select(F.expr(_deal("slots", n_shards)).alias("dealt"))
        .select(F.explode("dealt.out").alias("o"))
        .select(F.lit(version).alias("version"), F.col("o.virtual").alias("virtual"), F.col("o.shard").alias("shard"), F.col("o.bytes").alias("bytes"), F.col("o.n").alias("n"))
    )


def _deal(slots: str, n_shards: int) -> str:
    """SQL of the fold: loads by shard, and the slots dealt so far."""
    low = f"if(s.minus < 0, cast(array_position(a.loads, array_min(a.loads)) - 1 as int), cast(s.virtual % {n_shards} as int))"
    return (
        f"aggregate({slots}, named_struct('loads', array_repeat(0L, {n_shards}), 'out', cast(array() as array<struct<virtual:bigint,shard:int,bytes:bigint,n:bigint>>)), (a, s) -> named_struct("
        f"'loads', transform(a.loads, (l, i) -> if(i = {low}, l - s.minus, l)), "
        f"'out', array_append(a.out, named_struct('virtual', s.virtual, 'shard', {low}, 'bytes', -s.minus, 'n', s.n))))"
    )


def add_shard(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map, for one more shard: slots move only into the new shard.

    Each old shard, heaviest slots first, keeps slots up to the new mean and gives the rest away; of empty slots the
    new shard gets its share.
    """
    by_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual")
    held = slot_map.withColumn("mean", F.sum("bytes").over(Window.partitionBy()) / (n_shards + 1)).withColumn("upto", F.sum("bytes").over(by_shard))
    heavy = F.col("upto") > F.greatest(F.col("mean"), F.max("bytes").over(Window.partitionBy("shard")))
    moved = F.when(F.col("bytes") > 0, heavy).otherwise(F.col("virtual") % (n_shards + 1) == n_shards)
    return held.select((F.col("version") + 1).alias("version"), "virtual", F.when(moved, F.lit(n_shards)).otherwise(F.col("shard")).alias("shard"), "bytes", "n")


def save_slot_map(slot_map: DataFrame, folder: str) -> None:
    """Append a version to the stored map."""
    slot_map.write.mode("append").partitionBy("version").parquet(folder)


def load_slot_map(spark, folder: str, version: int | None = None) -> DataFrame:
    """A stored version; the latest by default."""
    stored = spark.read.parquet(folder)
    wanted = version if version is not None else stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == wanted)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, virtual). Size: UTF-8 bytes plus 1; a null text has size 1 and a null checksum.

    Rows with equal id, size and checksum are counted (in each task, then once a kind) and numbered from their
    count, RUN at a time, so that no task takes in all rows of a kind and each copy has a slot of its own.
    """
    text = F.col("text").cast("binary")
    kinds = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    kinds = kinds.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    once = kinds.where("copies = 1").withColumn("copy", F.lit(0).cast("long"))
    runs = kinds.where("copies > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    runs = runs.repartition(F.col("doc_id"), F.col("text_crc32"), F.col("run"))
    more = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("copies")) - 1)))
    columns = "doc_id", "size", "text_crc32", "copy"
    return once.select(*columns).union(more.select(*columns)).withColumn("virtual", virtual_slot()).drop("copy")


def shard_documents(docs: DataFrame, n_shards: int = 16, slot_map: DataFrame | None = None) -> DataFrame:
    """Every document's shard and its place there.

    Law ``bytes``: shards hold near equal sums of sizes. Returns doc_id, size, text_crc32, law, shard,
    slot (place within the shard, 0 to its count less 1), grown_shard (null under this law), virtual and map_version.

    Null texts have size 1; null ids are spread by checksum; repeated rows each get a place and a slot of their own;
    an empty table gives an empty result; further columns are ignored. With a stored ``slot_map`` its shards and its
    version are used, for records that it has never seen too; otherwise a map is made from the bytes that the
    slots hold.

    Only ids, sizes and checksums are shuffled, by virtual slot: thousands of groups of near equal size. A slot's
    rows are numbered within it and start where the slots before it in its shard end, so no task sees a shard.
    """
    records = measure(docs)
    load = slot_bytes(records)
    if slot_map is None:
        slot_map = build_slot_map(load, n_shards)
    else:
        slot_map = load.join(F.broadcast(slot_map.select("version", "virtual", "shard")), "virtual")
    # at most VIRTUAL_SLOTS rows, so the hint is safe whatever the number of documents
    by_shard = Window.partitionBy("shard").orderBy("virtual").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual", "shard", "version", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "virtual")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual", F.col("version").cast("int").alias("map_version"))
    )


def shard_and_store(docs: DataFrame, folder: str, n_shards: int = 16) -> DataFrame:
    """shard_documents by a map of these documents that is stored in folder first, as the next runs read it."""
    save_slot_map(build_slot_map(slot_bytes(measure(docs)), n_shards), folder)
    return shard_documents(docs, n_shards, load_slot_map(docs.sparkSession, folder))
