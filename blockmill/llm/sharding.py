"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the rows uniformly into buckets of about BUCKET_BYTES by a seeded hash of their key columns, one bucket to a partition.
Pass two shuffles each bucket in memory by Fisher-Yates (Spark's own shuffle() of an array, whose generator is seeded with the seed and
the partition's number, over rows in a fixed order) and writes it to the shared folder. The concatenated buckets are a uniform
permutation of all rows; it is cut into shards whose row counts differ by one at most (law "rows").

Text travels with its row through both passes. The number of buckets grows with the bytes, up to MOST_BUCKETS; from there on (16 TiB at
BUCKET_BYTES) buckets grow instead. Keys that repeat would meet in one bucket. So bytes are first counted by key; rows of a key that would
fill a quarter of a bucket are counted by content, and each of so many equal rows gets a number of its own, which its hash includes. At most
four keys a bucket are that frequent, which bounds what is broadcast, as does one row of two numbers for each bucket.

Defined cases: a null text has no bytes but counts as a row; null ids are hashed like any value; repeated rows are all kept, each in a
slot of its own and however many there are spread over all buckets; an empty table gives no rows; columns of the input called like the
outputs are replaced, all others are kept, whatever their names (map columns are not supported).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockmill.llm.common import new_path, quoted, release, staged, table

SHARDS = 40
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 20
ROW_BYTES = 16
SEED = 17


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text plus ROW_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shuffled(docs: DataFrame, key: tuple[str, ...] = ("doc_id", "text"), text_col: str = "text", shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """docs with shard int (0 to shards - 1) and slot long (gapless from 0 in each shard)."""
    docs = docs.drop("shard", "slot")
    keyed = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.xxhash64(*key, F.lit(seed)).alias("order"))
    by_key = staged(docs.groupBy(F.xxhash64(*key, F.lit(seed)).alias("order")).agg(F.sum(size_of(F.col(text_col))).alias("bytes"), F.count("*").alias("n")), "shard-keys")
    total, n = by_key.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(1, -(-total // bucket_bytes)))
    hot = staged(by_key.where((F.col("n") > 1) & (F.col("bytes") >= total / (4 * buckets))).select("order"), "shard-hot")
    if not hot.isEmpty():
        few = F.broadcast(hot)  # at most 4 * buckets keys
        copies = keyed.join(few, "order", "left_semi").groupBy("row").agg(F.count("*").alias("n"))
        apart = copies.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth")).select("row", F.xxhash64("row", "nth", F.lit(seed)).alias("order"))
        keyed = keyed.join(few, "order", "left_anti").select("row", "order").unionByName(apart)
    scattered = keyed.withColumn("bucket", F.pmod("order", F.lit(buckets)).cast("int")).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "order")
    passed = staged(
        scattered.groupBy("bucket").agg(F.shuffle(F.collect_list("row"), seed).alias("rows")).select("bucket", F.posexplode("rows").alias("at", "row")),
        "shuffled",
    )
    sizes = passed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = staged(sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before")), "shard-offsets")
    release(by_key, hot)
    shard = F.expr(f"place * {shards} div {max(n, 1)}").cast("int")
    placed = passed.join(F.broadcast(before), "bucket").select("row", (F.col("before") + F.col("at")).alias("place"))  # a row a bucket
    numbered = placed.select("row", "place", shard.alias("shard"))
    return numbered.select("row.*", "shard", F.expr(f"place - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"))


def write(shards: DataFrame, path: str | None = None) -> str:
    """Writes one folder of Parquet files a shard, rows in the order of their slots within each file; returns the path."""
    path = path or new_path(shards.sparkSession, "shards")
    shards.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffled(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size_of(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
