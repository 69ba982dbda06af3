"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled on the main path."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import BYTE_LEVEL, Encoder, pack_table, worker_encoder

#: The table of frequent pre-tokens: its rows, and the documents it is made from (none over SAMPLE_BYTES).
#: It only spares work; counts are exact without it.
TABLE_ROWS, SAMPLE_DOCS, SAMPLE_BYTES = 50_000, 1_500, 32_768


def frequent_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text", rows: int = TABLE_ROWS, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """Lengths of the most frequent pre-tokens of a bounded hash sample of documents, as a compact table."""
    total = docs.count()
    share = sample_docs / max(total, 1)
    u = F.pmod(F.xxhash64(text_col, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.where((u < share) & (F.octet_length(text_col) <= SAMPLE_BYTES)).select(text_col).limit(2 * sample_docs).collect()
    encoder = Encoder(tokenizer, counts=True)
    seen: Counter[str] = Counter()
    for (text,) in sample:
        if encoder.kind == BYTE_LEVEL:
            seen.update(encoder.find(text))
        elif encoder.kind:
            seen.update(encoder.find(text.lower()))
    kept = [p for p, _ in seen.most_common(rows) if len(p) <= 64 and "\0" not in p]
    return pack_table({p: encoder._piece(p) for p in kept})


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", table: bytes | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    Tier one is a broadcast table of frequent pre-token lengths, of at most TABLE_ROWS rows; tier two are the
    bounded caches of each worker, in front of the BPE model. ``tokenizer`` is a path: .json for the tokenizers
    library (its caches are exact there), .model for sentencepiece (whole texts). Null and empty texts count 0;
    null ids, repeated rows and other columns are kept apart row by row; empty tables give an empty result.
    """
    spark = docs.sparkSession
    pieces = tokenizer.endswith(".model")
    shared = spark.sparkContext.broadcast(b"" if pieces else table or frequent_lengths(docs, tokenizer, text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pieces:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            of = lambda t: len(model.encode(t)) if t else 0
        else:
            of = worker_encoder(tokenizer, True, shared.value).encode
        for batch in batches:
            sizes = [of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, "doc_id long, n_tokens long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
