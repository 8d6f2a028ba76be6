"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the rows by seeded hashes into buckets of a bounded size; pass two shuffles each bucket in
memory (Fisher-Yates, Spark's ``shuffle``) and numbers its rows after those of the buckets before it.  The
law is ``key``: a row's shard is the one of greatest seeded hash with its id (rendezvous hashing),
so one more shard takes rows only into itself.  A bucket never spans shards.

The shuffle's generator is seeded with the seed and the partition's number.  Buckets are therefore dealt to
a fixed number of partitions and sorted there, bucket contents too, so that a task that runs
again, or another run over the same rows, gives the same order.

Each shard has buckets for its own bytes and rows.  Many equal rows are counted instead of moved one by one, and
their copies are numbered and dealt to all buckets of their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Bytes of text, and rows, that a bucket holds on average; pass two needs a small multiple of it at once.
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 20_000
#: Equal rows beyond this number, or beyond a quarter of a bucket's bytes, are dealt to several buckets.
EQUAL_ROWS = 1000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is greatest; equal hashes: the higher number."""
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]) if shards > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"]


def _sized(docs: DataFrame, shards: int, seed: int, text: str, key: str) -> DataFrame:
    """``row`` (a struct of the columns, whatever their names), ``shard``, ``h`` (a hash of the whole row), ``size``."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    size = (F.octet_length(F.coalesce(F.col("row")[text], F.lit(""))) + 1).cast("long")
    return rows.select("row", shard_of(F.col("row")[key], shards, seed).cast("int").alias("shard"), F.xxhash64(F.lit(seed + 1), "row").alias("h"), size.alias("size"))


def scatter(docs: DataFrame, shards: int, *, seed: int, text: str, key: str, bucket_bytes: int, bucket_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Pass one: ``row``, ``shard``, ``bucket``; ``bucket`` and ``before`` (rows of its shard in earlier buckets); the number of buckets."""
    rows = _sized(docs, shards, seed, text, key)
    light = scratch.put(rows.select("shard", "h", "size"))
    totals = {r["shard"]: (r["bytes"], r["n"]) for r in light.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    per = [max(1, -(-b // bucket_bytes), -(-n // bucket_rows)) for b, n in (totals.get(s, (0, 0)) for s in range(shards))]
    first = [sum(per[:s]) for s in range(shards)]
    # the tables are joined, as thousands of shards would make long expressions
    plan = docs.sparkSession.createDataFrame(list(zip(range(shards), first, per, strict=True)), "shard int, first int, per int")
    dealt = lambda df: df.join(F.broadcast(plan), "shard").withColumn("bucket", (F.col("first") + F.pmod(F.xxhash64(F.lit(seed + 2), "h", "copy"), F.col("per"))).cast("int")).drop("first", "per", "copy")
    same = light.groupBy("shard", "h").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    same = scratch.put(same.withColumn("many", (F.col("n") > EQUAL_ROWS) | ((F.col("n") > 1) & (F.col("n") * F.col("size") > bucket_bytes / 4))))
    copies = same.select("shard", "h", F.when(F.col("many"), 1).otherwise(F.col("n")).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("many"), F.col("n") - 1).otherwise(0))).alias("copy"))
    counts = dealt(copies).groupBy("bucket").agg(F.first("shard").alias("of"), F.sum("n").alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.partitionBy("of").orderBy("bucket")) - F.col("n")).alias("before"))
    many = same.where("many").select("h")
    rows = rows.drop("size")
    plain = rows.join(F.broadcast(many), "h", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    equal = rows.join(F.broadcast(many), "h", "left_semi").groupBy("row", "shard", "h").agg(F.count(F.lit(1)).alias("n"))
    equal = equal.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    return dealt(plain.unionByName(equal)).drop("h"), before, sum(per)


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores behind it as no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def write_shards(docs: DataFrame, to: str, shards: int = 16, *, seed: int = 17, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> tuple[str, str]:
    """Writes whole rows, shuffled, as one folder for each shard, with ``slot``, gapless from 0 in each shard; rows lie in slot order in each file.

    All columns stay as they are.  Returns the names of the shard's and the slot's column: "shard" and "slot", with underscores behind
    if the table has such columns.  Rows without an id share a shard; repeated rows get slots of their own.
    """
    at, before, buckets = scatter(docs, shards, seed=seed, text=text, key=key, bucket_bytes=bucket_bytes, bucket_rows=bucket_rows, scratch=Scratch(docs.sparkSession, "shards"))
    packed = (
        at.repartitionById(min(buckets, 20_000), "bucket")  # up to 20,000 buckets each has a task of its own
        .groupBy("bucket")
        .agg(F.first("shard").alias("shard"), F.sort_array(F.collect_list("row")).alias("rows"))
        .sortWithinPartitions("bucket")
        .select("bucket", "shard", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "row"))
    )
    out = packed.join(F.broadcast(before), "bucket").select("row", "shard", (F.col("before") + F.col("pos")).cast("long").alias("slot"))
    named, slot = free_name("shard", docs.columns), free_name("slot", docs.columns)
    whole = out.sortWithinPartitions("shard", "slot").select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(named), F.col("slot").alias(slot))
    whole.write.partitionBy(named).parquet(to)
    return named, slot


def assign(docs: DataFrame, shards: int = 16, *, seed: int = 17, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Where each row went: key, size, text_crc32, law, shard, slot, grown_shard (with one more shard).

    The rows are written by ``write_shards`` to the shared folder; all columns come from the rows read back.  Size
    is the text's UTF-8 bytes plus 1; a null text has size 1 and checksum 0, as an empty one.  Rows without an id are
    keyed as one id (they share a shard).  Repeated rows get slots of their own.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    to = f"{Scratch(spark, 'sharded').root}/0"
    shard, slot = write_shards(docs, to, shards, seed=seed, text=text, key=key, bucket_bytes=bucket_bytes, bucket_rows=bucket_rows)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (key, text)}
    back = spark.read.schema(", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", `{slot}` long, `{shard}` int").parquet(to)
    raw = F.coalesce(F.col(text), F.lit(""))
    return back.select(
        F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), shard_of(F.col(key), shards + 1, seed).cast("int").alias("grown_shard"),
    )
