"""Sharding by sampled splitters (native): near-equal bytes in every shard."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, discard, long_array, partitions, staged
from .splitters import sampled_ranges

LOWEST = -(2**63)


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 32, sample_rows: int = 20_000) -> DataFrame:
    """Deal documents into ``n_shards`` shards of near-equal size under the law ``bytes``.

    Keys are (hash of the text, id, a row number of this run), so equal texts lie side by side and a group
    of copies that is larger than a range is cut. Splitters come from a size-weighted sample of at most
    about ``sample_rows`` keys; exact sums of the ranges follow, and overfull ranges are sampled again and
    subdivided. A document's shard is where its first byte falls when the ranges are laid end to end, so a
    shard differs from total / n_shards by less than its largest document.

    Only ids, sizes and checksums are shuffled, never texts. Null text: size 8, checksum 0. Null ids order
    first. Repeated rows are each placed, and a group of equal texts that a shard's end cuts goes on in the next
    shard: the law ``bytes`` holds before togetherness. Texts of any length count whole; one longer than a share
    fills its shard alone. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.col(text_col).cast("binary")
    rows = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
            F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.col(text_col)).alias("_h"),
            F.monotonically_increasing_id().alias("_n"),
        ).withColumn("_i", F.coalesce("doc_id", F.lit(LOWEST))),
        "shard-keys",
    )
    fields = ("_h", "_i", "_n")
    got = sampled_ranges(rows, fields, "size", max(n_shards * ranges_per_shard, 4 * partitions(spark)), sample_rows)
    total = max(1, sum(got.weights))
    first_byte, first_row = [0, *accumulate(got.weights)], [0, *accumulate(got.rows)]
    w = Window.partitionBy("_r").orderBy(*fields)
    start = F.get(long_array(first_byte), F.col("_r")) + F.sum("size").over(w) - F.col("size")
    at = F.get(long_array(first_row), F.col("_r")) + F.row_number().over(w) - 1
    placed = staged(
        rows.withColumn("_r", got.of(F.struct(*fields)))
        .select("doc_id", "size", "text_crc32", start.alias("_s"), at.alias("_at"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"_s * {n_shards} div {total}L")).cast("int"))
        .drop("_s"),
        "shard-places",
    )
    discard(rows)
    begins = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_at")).collect()}
    base = long_array([begins.get(s, 0) for s in range(n_shards)])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_at") - F.get(base, F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 24)
