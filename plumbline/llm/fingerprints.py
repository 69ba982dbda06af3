"""Homomorphic multiset fingerprints of documents (native).

A text is cut into paragraphs: pieces between line breaks, and within a line at white space after . ! or ?.
Each paragraph hashes to a wide vector of LANES signed bytes; a fingerprint is the sum of these vectors
modulo 2**16 in each lane, written as four hex digits a lane. The sum ignores order, equal texts have equal
fingerprints, and a paragraph can be inserted or deleted by adding or subtracting its vector. As lanes are
small random numbers, the cosine of two sums estimates the cosine of the two multisets (error 1/sqrt(LANES)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, long_array, partitions, staged
from .splitters import sampled_ranges

WORDS, LANES, MODULUS = 8, 64, 1 << 16
LOWEST = -(2**63)
PARAGRAPH_BREAK = r"[\n\r]+\s*|(?<=[.!?])\s+"


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), PARAGRAPH_BREAK)


def packed_sums(unit: Column) -> list[Column]:
    """Sums of the vectors of a group's paragraphs, two lanes a long: bytes j and j + 4 of each hash word.

    A long holds up to eight million paragraphs before a lane would reach the next; an empty paragraph is
    the zero vector.
    """
    real = F.length(unit) > 0
    words = [F.when(real, F.xxhash64(F.lit(k), unit)).otherwise(F.lit(0).cast("long")) for k in range(WORDS)]
    mask = F.lit(0xFF000000FF)
    return [F.sum(F.shiftrightunsigned(words[k], 8 * j).bitwiseAND(mask)).alias(f"_p{4 * k + j}") for k in range(WORDS) for j in range(4)] + [F.sum(real.cast("long")).alias("_units")]


def unpacked() -> Column:
    """Array of centred lanes from ``packed_sums``: bytes count from -128, then modulo MODULUS."""
    low = lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF))
    lanes = F.array(*[x for i in range(WORDS * 4) for x in (low(F.col(f"_p{i}")), F.shiftrightunsigned(F.col(f"_p{i}"), 32))])
    return F.transform(lanes, lambda x: F.pmod(x - F.col("_units") * 128 + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2)


def to_hex(lanes: Column) -> Column:
    """Four hex digits for each lane of an array."""
    return F.concat_ws("", F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(F.pmod(x, F.lit(MODULUS)).cast("long")), 4, "0"))))


def from_hex(fp: Column) -> Column:
    """Array of centred lanes, -2**15 to 2**15 - 1."""
    at = F.sequence(F.lit(0), F.lit(LANES - 1))
    value = lambda i: F.conv(F.substring(fp, i * 4 + 1, 4), 16, 10).cast("long")
    return F.transform(at, lambda i: F.pmod(value(i) + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union (sign 1) of two multisets, or of a without b (sign -1)."""
    both = F.zip_with(from_hex(a), from_hex(b), lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))
    return to_hex(both)


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two arrays of centred lanes, held to 0..1; equal arrays give 1, a zero vector beside another 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size)))


def text_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row; texts never leave their partition, sums are made before the shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), F.monotonically_increasing_id().alias("_n"))
    rows = rows.select("doc_id", "_n", F.explode(paragraphs(F.col("_t"))).alias("_u"))  # numbered before rows are multiplied
    sums = rows.groupBy("doc_id", "_n").agg(*packed_sums(F.col("_u")))
    return sums.select("doc_id", to_hex(unpacked()).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edited_part: int = 3, ranges: int | None = None) -> DataFrame:
    """Fingerprint every text, its edited text and their likeness.

    The edited text has its last floor(n_chars / edited_part) code points replaced by as many from the start
    of the next document in descending id order (all of them where it is shorter; after the last the first).

    One shuffle of the texts: rows go to ranges of (id, hash of the text) from sampled splitters that weigh bytes,
    and the first rows of a range are also sent to the range above it, so that each row finds the next one in
    its own range. The sums of the vectors run on that partitioning. Null text counts as empty (fingerprint all
    zero); null ids come last; rows with equal ids are ordered by a hash of their text, so a crowd of null or
    repeated ids is cut like any other. Texts of any length are taken whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_i"), F.xxhash64(text).alias("_j")]
    keys = staged(docs.select(*key, (F.octet_length(text) + 64).cast("long").alias("_w")), "fingerprint-keys")
    found = sampled_ranges(keys, ("_i", "_j"), "_w", ranges or max(64, 4 * partitions(spark)))
    in_range = found.of(F.struct("_i", "_j"))
    tops = {r[0]: (r[1]._i, r[1]._j) for r in keys.groupBy(in_range.alias("_r")).agg(F.max(F.struct("_i", "_j"))).collect()}  # a row a range
    discard(keys)
    full = sorted(tops)
    count = len(found.boundaries) + 1
    above = {a: b for a, b in zip(full, full[1:], strict=False)}
    top_i, top_j = (long_array([tops.get(r, (0, 0))[k] for r in range(count)]) for k in (0, 1))
    target = long_array([above.get(r, -1) for r in range(count)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, text.alias("_t"))
    rows = rows.withColumn("_own", in_range.cast("long"))
    nowhere = F.lit(-1).cast("long")
    is_top = (F.col("_i") == F.get(top_i, F.col("_own"))) & (F.col("_j") == F.get(top_j, F.col("_own")))
    dealt = F.array(
        F.col("_own"),
        F.when(is_top, F.get(target, F.col("_own"))).otherwise(nowhere),
        F.when(is_top & (F.col("_own") == (full[-1] if full else 0)), F.lit(full[0] if full else 0).cast("long")).otherwise(nowhere),
    )
    rows = rows.select("doc_id", "_i", "_j", "_t", F.posexplode(dealt).alias("_ghost", "_r")).where("_r >= 0")
    order = Window.partitionBy("_r").orderBy(F.col("_ghost") > 0, F.col("_i").desc(), F.col("_j").desc(), "_ghost")
    rows = rows.select("*", F.lead("_t").over(order).alias("_next"), F.row_number().over(order).alias("_k")).where("_ghost = 0")
    n = F.length("_t")
    cut = F.floor(n / F.lit(edited_part)).cast("int")
    edited = F.concat(F.substring(F.col("_t"), F.lit(1), n - cut), F.substring(F.coalesce("_next", "_t"), F.lit(1), cut))
    rows = rows.select("_r", "_k", "doc_id", "_t", F.coalesce("_next", "_t").alias("_next"), n.cast("long").alias("n_chars"), edited.alias("_e"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_e").cast("binary"), 256))
    tagged = lambda side, c: F.transform(paragraphs(F.col(c)), lambda u: F.struct(F.lit(side).alias("s"), u.alias("u")))
    units = rows.select("_r", "_k", "doc_id", "n_chars", "edited_sha256", F.explode(F.concat(tagged(0, "_t"), tagged(1, "_e"), tagged(2, "_next"))).alias("_x"))
    row = ("_r", "_k", "doc_id", "n_chars", "edited_sha256")
    sums = units.groupBy(*row, F.col("_x.s").alias("_s")).agg(*packed_sums(F.col("_x.u"))).select(*row, "_s", unpacked().alias("_v"))
    sides = sums.groupBy(*row).agg(*[F.max(F.when(F.col("_s") == s, F.col("_v"))).alias(f"_v{s}") for s in range(3)])
    v = [F.col(f"_v{s}") for s in range(3)]
    return sides.select(
        "doc_id", "n_chars", "edited_sha256",
        to_hex(v[0]).alias("fingerprint"), to_hex(v[1]).alias("edited_fingerprint"),
        likeness(v[0], v[1]).alias("near_edited"), likeness(v[0], v[2]).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
