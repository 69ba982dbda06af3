import collections
import struct
import zlib

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import jaccard

from ..conftest import SF
from .test_llm import brute_components


def test_each_stage_on_what_the_last_one_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 == len(corpus_pipeline.STAGES):
            break
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert set(rows) <= set(seen) and len(rows) > 0.5 * len(seen)
        if name == "line_dedup":
            for d, t in rows.items():
                kept = collections.Counter(t.split("\n"))
                assert not kept - collections.Counter(seen[d].split("\n"))
        else:
            assert all(rows[d] == seen[d] for d in rows)
        if name == "ngram_jaccard_join":
            want = {r[3] for r in brute_components(sorted(seen.items()))}
            assert set(rows) == want
        if name == "benchmark_decontamination":
            assert {d for d in seen if d not in rows} == {d for d, t in seen.items() if any(i.casefold() in t.casefold() for i in items)}
        seen = rows
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(seen)
    assert jaccard.PERCENT == 75 and jaccard.WORDS == 5


def test_whole_run(spark):
    """The rows of run() are the pieces, by the library, of exactly the texts that the stages keep one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in docs.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(places) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_stages_with_python_bound_their_batches(spark):
    """Batches of 64 MiB took executors past their memory; a lower bound that a session has stays."""
    from pyspark.sql import functions as F

    import corpus_pipeline
    from plumbline.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 400)).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    spark.conf.unset(name)
    try:
        corpus_pipeline.best_fit_packing(spark, docs, SF)
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(got) > 1 and max(got) < 1.1 * common.BATCH_BYTES
        spark.conf.set(name, "1m")
        common.small_batches(spark)
        assert spark.conf.get(name) in ("1m", "1048576b")
    finally:
        spark.conf.unset(name)
