"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._tables import column

#: Hex digits of a record's digest that name its slot bucket: 16**2 buckets, each ordered by itself.
BUCKET_DIGITS = 2
SHARDS = 24


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that record and shard decide: 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the least -ln(u) / weight, the lower shard on ties; shards of weight 0 get none.

    A new shard takes records only into itself, and a change of one weight moves records only to or
    from that shard. The choice depends on the key and the weights alone.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight above 0")
    costs = [F.struct((-F.ln(_draw(key, i)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def rendezvous_shards(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown_weight: float | None = None, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row.

    The key is hashed as its text (null as the empty text), so null keys share a shard. `size` is
    the UTF-8 bytes of the text plus 8; a null text counts and is summed as an empty one. `slot`
    numbers a shard's rows from 0 without gaps: buckets by the key's digest are counted, their
    totals give each bucket its offset, and rows are numbered inside their bucket by (key, size,
    text_crc32); rows equal in these take any order. `grown_shard` is the shard once one more of
    `grown_weight` (that of the last shard, if not given) is added. Only key, size and checksum are
    shuffled, by (shard, bucket); no task holds a whole shard.
    """
    bytes_ = F.coalesce(column(docs, text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(column(docs, key).alias("key"), (F.octet_length(bytes_) + F.lit(8)).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    rows = rows.select("*", rendezvous(name, weights).alias("shard"), rendezvous(name, [*weights, weights[-1] if grown_weight is None else grown_weight]).alias("grown_shard"), F.substring(F.md5(name), 1, bucket_digits).alias("bucket"))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(inside))
    # shards * 16**bucket_digits rows at most
    out = numbered.join(F.broadcast(offsets) if len(weights) << (4 * bucket_digits) <= 1 << 20 else offsets, ["shard", "bucket"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")


def op6_rendezvous(spark, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards."""
    return rendezvous_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS)


OP6_SQL = """
WITH k AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name, coalesce(text, '') AS text FROM documents),
draws AS (SELECT doc_id, name, s, -ln((CAST('0x' || substr(md5(name || ':' || s), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS cost FROM k, range(25) r(s)),
best AS (SELECT doc_id, CAST(arg_min(s, cost) FILTER (s < 24) AS INTEGER) AS shard, CAST(arg_min(s, cost) AS INTEGER) AS grown_shard FROM draws GROUP BY doc_id),
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)))
SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(name), 1, 2), doc_id) - 1 AS slot, grown_shard
FROM k JOIN best USING (doc_id), crc
"""
