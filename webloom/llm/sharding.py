"""Sharding by global byte-size prefix sums: contiguous shards of nearly equal bytes (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put rows, in order of id, into n_shards contiguous shards of nearly equal bytes.

    Rows are range-partitioned; each partition's total gives, summed over those before it, the
    offset of its first row, so no task sees more than its own partition and the totals. A row
    belongs to the shard in which its first byte falls when all bytes are cut at n equal targets.

    Size is the UTF-8 length of the text plus 1 (null text: 1). Rows with a null id come first.
    Rows with equal ids are ordered by checksum, then size; fully equal rows are interchangeable.
    An empty table gives an empty result. Columns other than id and text are ignored.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "shard-sizes")
    key = ["doc_id", "text_crc32", "size"]
    rows = stash(rows.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "shard-parts")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)})
    placed = run.join(offsets, "part").select(
        *key,
        F.least(F.lit(n_shards - 1).cast("long"), F.floor((F.col("bytes_before") + F.col("upto") - F.col("size")) * n_shards / F.col("all_bytes"))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("position"),
    )
    placed = stash(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    # one row a shard: n_shards bounds what is broadcast
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of nearly equal bytes."""
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)


#: The checksum goes byte by byte over a table of 256 values, made from the polynomial.
OP4_SQL = """
WITH t AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
tab AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS x FROM range(256) r(i))),
crc AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], [CAST('0x' || b AS BIGINT) for b in regexp_extract_all(h, '..')]), lambda a, b: xor(c[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS text_crc32 FROM t, tab),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS nth FROM crc),
p AS (SELECT *, CAST(least(15, (upto - size) * 16 // total) AS INT) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""
