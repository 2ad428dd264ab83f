"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank is
``(rank - 1/2) / rows of its source``.  Sorting all rows by fractional rank interleaves the sources in
proportion to their sizes, so that any run of consecutive rows, and hence every shard, has the mixture of the
whole corpus.  Shard ``k`` takes the positions from ``floor(k N / S)`` on: row counts differ by one at most.

Ranks come without a window over a whole source (one source may hold a third of all rows): rows are dealt by
their hash, which is uniform, into buckets of bounded expected size; bucket counts give each bucket's offset and a
window over one bucket gives the rest.  The same is done for the position by fractional rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, read_table

#: Expected rows of one ranking bucket.
BUCKET_ROWS = 4096
#: Values of the seeded hash.
HASH_SPAN = 1 << 48


def _buckets(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def interleave(docs: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """Deal every row of ``docs`` (doc_id, text, source) into shards.

    Returns doc_id, source, size (UTF-8 bytes of the text plus 1), text_crc32, frac (fractional rank), shard and
    slot (gapless from 0 in each shard).  Defined cases: a null text has no bytes and crc32 0; null sources are one
    stratum; null or repeated doc_ids are ordinary rows (ties are broken by crc32 and size; rows equal in all of
    these are interchangeable); an empty table gives no rows; other columns are ignored.
    """
    binary = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(binary) + 1).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
    ).withColumn("h", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long"))
    rows = materialise(rows, "shard-rows")

    # Bucket width by the rows of the largest source; a row a source goes to the driver's plan only as a count.
    sources = rows.groupBy("source").agg(F.count("*").alias("n"))
    largest, total = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = _buckets(largest)
    rows = rows.withColumn("b", F.floor(F.col("h") / F.lit(HASH_SPAN / first)).cast("long"))
    counts = rows.groupBy("source", "b").agg(F.count("*").alias("c"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offsets = offsets.withColumn("n", F.sum("c").over(W.partitionBy("source"))).drop("c")

    tie = ["h", "doc_id", "text_crc32", "size"]
    # Both sides carry one key so that the join is an equality join; null sources meet each other.
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("source", "b").orderBy(*tie)))
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("b").alias("o_b"), "before", "n")
    ranked = ranked.join(offsets, ranked["source"].eqNullSafe(offsets["o_source"]) & (ranked["b"] == offsets["o_b"]))
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "h", ((F.col("before") + F.col("r") - 0.5) / F.col("n")).alias("frac"))

    second = _buckets(total)
    ranked = materialise(ranked.withColumn("q", F.floor(F.col("frac") * second).cast("long")), "shard-ranks")
    # One row a bucket of 4096: the only table that is summed in order of bucket, in two levels.
    per = ranked.groupBy("q").agg(F.count("*").alias("c")).withColumn("block", F.floor(F.col("q") / 1024))
    blocks = per.groupBy("block").agg(F.sum("c").alias("bc"))
    blocks = blocks.withColumn("block_before", F.coalesce(F.sum("bc").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    per = per.join(blocks, "block").withColumn("q_before", F.col("block_before") + F.coalesce(F.sum("c").over(W.partitionBy("block").orderBy("q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("frac", "source", *tie)))
    placed = placed.join(per.select(F.col("q").alias("p_q"), "q_before"), F.col("q") == F.col("p_q"))
    at = (F.col("q_before") + F.col("r") - 1).cast("long")
    # position p lies in shard k where floor(k N / S) <= p < floor((k+1) N / S)
    placed = placed.withColumn("at", at).withColumn("shard", F.expr(f"cast(((at + 1) * {n_shards} - 1) div {max(total, 1)} as int)"))
    start = F.expr(f"cast((cast(shard as bigint) * {total}) div {n_shards} as bigint)")
    return placed.withColumn("slot", F.col("at") - start).select("doc_id", "source", "size", "text_crc32", "frac", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


# The same in one query over whole sources: ranks by windows, the checksum byte by byte from its polynomial.
ORACLE = """
with steps as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) t),
byte as (select doc_id, source, coalesce(text, '') text, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda p: ('0x' || p)::ubigint) b from documents),
row as (
  select doc_id, source, strlen(text) + 1 size, xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255)::bigint + 1])), 4294967295::ubigint)::bigint text_crc32,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint h
  from byte, steps),
ranked as (select *, (row_number() over (partition by source order by h, doc_id, text_crc32, size) - 0.5::double) / count(*) over (partition by source) frac from row),
placed as (select *, row_number() over (order by frac, source, h, doc_id, text_crc32, size) - 1 pos, count(*) over () total from ranked)
select doc_id, size, text_crc32, 'rows' law, (((pos + 1) * 16 - 1) // total)::int shard, pos - ((((pos + 1) * 16 - 1) // total) * total) // 16 slot, null::int grown_shard, source from placed
"""
