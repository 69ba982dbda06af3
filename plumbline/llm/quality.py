"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits, or runs of one sign. Features are hashed n-grams in five sets, each scaled to
unit length: single words, pairs and triples of words, and pairs and triples of word shapes (case, digits, the sign
itself, a word said again). A score is the logistic function of a sparse dot product. Rows with crc32(doc_id as
text) mod 3 = 1 are never learned from.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, unused
from .tokens import kept_by_worker, together

BITS = 20
#: The model is fitted on a hash sample of labelled rows, of at most about FIT_ROWS rows and FIT_BYTES bytes of
#: text; texts are cut nowhere. Every row is scored.
FIT_ROWS, FIT_BYTES = 6_000, 32 << 20
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 4
WORD = r"[^\W_]+|([^\w\s])\1*|_+"
#: Sets of features by number: words, pairs, triples, pairs of shapes, triples of shapes.
SETS = 5
#: Bytes that a worker's table of chunks holds.
TABLE_BYTES = 48 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as decimal text, modulo 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _follow(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    with np.errstate(over="ignore"):
        x = (x * _A) ^ y
        return (x ^ (x >> np.uint64(29))) * _B


class _Chunks(dict):
    """Numbers of chunks between white space; their words' hashes and shapes lie in arrays."""

    def __init__(self, word):
        super().__init__()
        self.word, self.bytes = word, 0
        self.first, self.hashes, self.shapes = array("q", [0]), array("Q"), array("Q")
        self.of_shape: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        import xxhash

        if chunk.isalpha():
            parts = (chunk,)
        elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            parts = (chunk[:-1], chunk[-1])
        else:
            parts = [m[0] for m in self.word.finditer(chunk)]
        for part in parts:
            self.hashes.append(xxhash.xxh64_intdigest(part.lower()))
            s = shape(part)
            if (h := self.of_shape.get(s)) is None:
                h = self.of_shape[s] = xxhash.xxh64_intdigest("shape " + s)
            self.shapes.append(h)
        k = len(self.first) - 1
        self.first.append(len(self.hashes))
        self.bytes += 180 + 16 * (self.first[-1] - self.first[-2])
        if len(chunk) <= 64:
            self[chunk] = k
            self.bytes += len(chunk)
        return k


class Features:
    """Hashed features of texts: places 0 to 2**bits - 1. The table of chunks is bounded in bytes."""

    def __init__(self, bits: int = BITS, limit: int = TABLE_BYTES):
        import re

        self.word, self.shift, self.limit = re.compile(WORD), np.uint64(64 - bits), limit
        self.chunks = _Chunks(self.word)

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place, value) of the features of all texts, set by set; a row has each place of a set once, in order of row and place."""
        if self.chunks.bytes > self.limit:
            self.chunks = _Chunks(self.word)
        parts = [t.split() if t else [] for t in texts]
        n = [len(p) for p in parts]
        at = np.fromiter((k for p in parts for k in map(self.chunks.__getitem__, p)), np.int64, sum(n))
        del parts
        first = np.array(self.chunks.first)
        size = first[at + 1] - first[at]
        place = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row = np.repeat(np.repeat(np.arange(len(texts)), n), size)
        words = np.array(self.chunks.hashes, np.uint64)[place]
        shapes = np.array(self.chunks.shapes, np.uint64)[place]
        same = row[1:] == row[:-1]
        with np.errstate(over="ignore"):
            shapes[1:] += (same & (words[1:] == words[:-1])).astype(np.uint64) * _A
        for k in range(SETS):
            if k in (0, 1, 3):
                grams = words if k < 3 else shapes
            if k in (1, 3):
                grams, rows, both = _follow(grams[:-1], grams[1:]), row[:-1], same
            elif k in (2, 4):
                grams, rows, both = _follow(grams[:-1], (words if k < 3 else shapes)[2:]), row[:-2], same[:-1] & same[1:]
            else:
                rows, both = row, np.ones(len(row), bool)
            places = _follow(grams, np.full(1, k, np.uint64))[both] >> self.shift
            rows = rows[both]
            if len(rows):
                yield rows_and_values(rows, places, len(texts))


def rows_and_values(rows: np.ndarray, places: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct places with the roots of their counts, scaled to unit length."""
    keys = rows.astype(np.uint64) << np.uint64(32) | places
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(first, len(keys)))
    row = (keys[first] >> np.uint64(32)).astype(np.int64)
    return row, (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.sqrt(count / np.bincount(rows, minlength=n_rows)[row])


def shape(word: str) -> str:
    """Case and kind of a word: its sign with the run's length class, or Xx, XX, x with a length class."""
    size = "1" if len(word) == 1 else "2" if len(word) < 4 else "4" if len(word) < 10 else "L"
    if not (word[0].isalnum()):
        return word[0] + size
    if word.isdigit():
        return "9" + size
    return ("X" if word.isupper() and len(word) > 1 else "Xx" if word[0].isupper() else "x" if word.islower() else "xX") + ("L" if size == "L" else "")


class Ftrl:
    """FTRL-proximal logistic regression over hashed places; the last weight is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float) -> None:
        """``at`` holds each place once."""
        w = self.weights(at)
        g = (float(sigmoid(w @ x)) - y) * x * weight
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -35.0, 35.0)))


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, fit_bytes: int) -> DataFrame:
    """(id, y, text): a hash sample of labelled rows that aren't held out, one row an id.

    An id with several labels has the least of them; one with several texts that with the smallest hash. Ids are
    taken in an order fixed by their hash, as long as rows and bytes of text are within the bounds; one that
    would pass the bound of bytes is passed over.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    order = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30))
    chance = fit_rows / max(known.count(), 1)
    sample = known.where(order / F.lit(float(1 << 30)) < chance).orderBy(order, "id").limit(2 * fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    mark = F.coalesce(F.xxhash64("text"), F.lit(0))
    sizes = texts.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), mark.alias("mark")).join(F.broadcast(sample), "id")
    first = sizes.groupBy("id", "y").agg(F.min(F.struct("mark", "size")).alias("m")).select("id", "y", "m.mark", "m.size").collect()  # at most 2 * fit_rows rows
    first.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id))
    left, kept = fit_bytes, []
    for r in first:
        if r.size <= left:
            left -= r.size
            kept.append((r.id, r.y, r.mark))
    chosen = F.broadcast(spark.createDataFrame(kept, "id long, y int, chosen long"))
    rows = texts.join(chosen, "id").where(mark == F.col("chosen"))
    return rows.groupBy("id", "y").agg(F.first("text", ignorenulls=True).alias("text"))


def train_quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (float32, 2**bits and the bias) from labelled rows that aren't held out; without any, all zero (scores 0.5).

    Features are made on all executors; one task learns from them, in an order fixed by a hash of the id, and sends
    the weights alone to the driver. Null labels
    and ids join nothing; repeated labels and texts of an id count once (see ``fit_sample``). Classes are
    weighted to count alike.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = kept_by_worker(("features", bits), lambda: Features(bits))
        for b in batches:
            texts, at, x = b.column(2).to_pylist(), [], []
            for run in together(texts):
                sets = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)], *make.of(run)]
                row, place, value = (np.concatenate(c) for c in zip(*sets, strict=True))
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(len(run) + 1))
                for i, j in zip(cuts, cuts[1:], strict=False):
                    places, where = np.unique(place[order[i:j]], return_inverse=True)
                    at.append(places.astype("<i4").tobytes())
                    x.append(np.bincount(where, value[order[i:j]], len(places)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["id", "y", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        held.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        n = [max(1, sum(r[1] == c for r in held)) for c in (0, 1)]
        weight = [min(4.0, sum(n) / (2 * c)) for c in n]
        model = Ftrl(bits)
        for _ in range(epochs):
            for _, y, at, x in held:
                model.learn(np.append(np.frombuffer(at, "<i4"), 1 << bits), np.append(np.frombuffer(x, "<f4"), 1.0).astype(float), y, weight[y])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())], ["w"])

    sample = fit_sample(docs, labels, id_col, text_col, label_col, fit_rows, fit_bytes).mapInArrow(features, "id long, y int, at binary, x binary")
    got = sample.repartition(1).mapInArrow(learn, "w binary").collect()  # the sample is bounded, so one task learns from it
    return np.frombuffer(got[0].w, "<f4") if got else np.zeros((1 << bits) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """The rows of ``docs`` with a column ``out_col``: 0 to 1, higher where a good label is likelier.

    Only the text decides, the whole of it however long. Null and empty texts get the bias score. Repeated rows
    are each scored, an empty table stays empty. All other columns pass through; one named ``out_col`` is replaced.
    """
    docs = docs.drop(out_col) if out_col in docs.columns else docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(len(weights)).bit_length() - 1
    names = docs.columns
    at_text = names.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = kept_by_worker(("features", bits), lambda: Features(bits)), shared.value
        for b in batches:
            scores = []
            for run in together(b.column(at_text).to_pylist()):
                total = np.full(len(run), float(w[-1]))
                for row, place, value in make.of(run):
                    total += np.bincount(row, w[place] * value, len(run))
                scores.append(sigmoid(total))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, out_col])

    return docs.mapInArrow(score, docs.select("*", F.lit(0.5).alias(out_col)).schema)


def quality_stage(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, source: DataFrame | None = None) -> DataFrame:
    """Documents that the classifier keeps: score at or over the threshold. Columns are those of ``docs``, whatever their names."""
    weights = train_quality(source if source is not None else docs, labels)
    score = unused("score", docs)
    return score_quality(docs, weights, out_col=score).where(F.col(score) >= threshold).drop(score)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, weights, out_col="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
