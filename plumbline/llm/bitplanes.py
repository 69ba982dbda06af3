"""Token files of bit-plane shuffled blocks.

A file holds blocks of up to BLOCK ids. A block is transposed into planes: bit k (or byte k) of all its ids,
each plane compressed with zstandard on its own. A chunk index at the end gives each block's place, ids and
plane sizes, followed by the documents' ids and lengths, so any block or document can be read by itself.

Layout: MAGIC, the planes of block after block, the index (zstandard), then its place and size and MAGIC.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_folder, partitions, staged
from .tokens import worker_encoder

MAGIC, BLOCK, LEVEL = b"PLBITPL1", 1 << 16, 3


def to_planes(ids: np.ndarray, width: int, by: str = "bit") -> list[bytes]:
    """Planes 0 to width - 1 of unsigned 32-bit ids; the last byte of a bit plane is padded with zeros."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if by == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw[:, : -(-width // 8)], axis=1, bitorder="little")[:, :width]
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return [p.tobytes() for p in packed]


def from_planes(planes: list[bytes], n: int, by: str = "bit") -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if by == "byte":
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    elif planes:
        rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
        bits = np.unpackbits(rows, axis=1, bitorder="little", count=n).T
        low = np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little")
        raw[:, : low.shape[1]] = low
    return raw.view("<u4").reshape(-1)


class PlaneWriter:
    """Streams ids into a file object; holds one block at most besides the index."""

    def __init__(self, out, block: int = BLOCK, by: str = "bit", level: int = LEVEL):
        import zstandard

        self.out, self.block, self.by, self.pack = out, block, by, zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held = self.at = self.n_ids = 0
        self.blocks: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[int | None, int]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        while len(ids):
            part, ids = ids[: self.block - self.n_held], ids[self.block - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.block:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.held)
        top = int(ids.max())
        width = top.bit_length() if self.by == "bit" else -(-top.bit_length() // 8)
        begin, sizes = self.at, []
        for plane in to_planes(ids, width, self.by):
            self._put(data := self.pack(plane))
            sizes.append(len(data))
        self.blocks.append((begin, len(ids), sizes))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        head = struct.pack("<BQQ", self.by == "bit", len(self.blocks), len(self.docs))
        table = b"".join(struct.pack(f"<QIB{len(s)}I", at, n, len(s), *s) for at, n, s in self.blocks)
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes()
        none = np.packbits(np.array([d is None for d, _ in self.docs], np.uint8)).tobytes()
        index = self.pack(head + table + ids + none + np.array([n for _, n in self.docs], "<u8").tobytes())
        begin = self.at
        self._put(index + struct.pack("<QQ", begin, len(index)) + MAGIC)


class PlaneReader:
    """Reads the index first, then single blocks by their place."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        end = source.size()
        tail = source.read_at(24, end - 24)
        if tail[16:] != MAGIC:
            raise ValueError("not a bit-plane file")
        at, size = struct.unpack("<QQ", tail[:16])
        raw = self.unpack(source.read_at(size, at))
        bit, n_blocks, n_docs = struct.unpack_from("<BQQ", raw)
        self.by, pos = "bit" if bit else "byte", struct.calcsize("<BQQ")
        self.blocks = []
        for _ in range(n_blocks):
            begin, n, k = struct.unpack_from("<QIB", raw, pos)
            pos += struct.calcsize("<QIB")
            self.blocks.append((begin, n, struct.unpack_from(f"<{k}I", raw, pos)))
            pos += 4 * k
        ids = np.frombuffer(raw, "<i8", n_docs, pos)
        pos += 8 * n_docs
        none = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n_docs // 8), pos), count=n_docs)
        pos += -(-n_docs // 8)
        self.lengths = np.frombuffer(raw, "<u8", n_docs, pos)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, none, strict=True)]

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        raw = self.source.read_at(sum(sizes), at)
        cuts = [0, *accumulate(sizes)]
        return from_planes([self.unpack(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], n, self.by)

    def pieces(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(number of the document, some of its ids, whether they end it), in order, one block in memory."""
        ids, k = np.zeros(0, "<u4"), 0
        for i, n in enumerate(map(int, self.lengths)):
            while n > len(ids):
                if len(ids):
                    yield i, ids, False
                    n -= len(ids)
                ids, k = self.block(k), k + 1
            yield i, ids[:n], True
            ids = ids[n:]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def table_bytes(rows: DataFrame) -> int:
    """What the planner knows of a frame's size; where it knows nothing, the bytes of its texts are counted."""
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 55 else rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


#: Bytes of the table that a file holds at most, about; rows that a batch of read documents has at most.
FILE_BYTES, READ_ROWS = 256 << 20, 1 << 16


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, by: str = "bit") -> DataFrame:
    """Encode whole texts and write them as token files in ascending id order; returns the staged manifest.

    The manifest has a row for each file: shard (the files' order), path, n_docs, n_tokens. Ids are range
    partitioned, so every file holds one range. A task that runs twice writes two files under different names,
    and only the one that its committed manifest row names is ever read. ``folder`` is a shared URI.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = max(partitions(docs.sparkSession), -(-table_bytes(rows) // FILE_BYTES))
    dealt = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, path, writer = worker_encoder(tokenizer), None, "", None
        end = np.array([end_id], "<u4")
        for batch in batches:
            if batch.num_rows and writer is None:
                fs, base = _open(folder)
                fs.create_dir(base, recursive=True)
                path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.planes"
                out = fs.open_output_stream(f"{base}/{path.rpartition('/')[2]}")
                writer = PlaneWriter(out, block, by)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                writer.add(doc_id, np.concatenate([np.frombuffer(encoder.encode(text), "<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_ids]})

    return staged(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "planes-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that a manifest names."""
    spark = manifest.sparkSession
    files = manifest.orderBy("shard").collect()  # a row for each partition of the writing stage
    starts = [0, *accumulate(f.n_tokens for f in files)]
    todo = spark.createDataFrame([(f.path, s) for f, s in zip(files, starts, strict=False)], "path string, start long")
    todo = todo.repartition(max(1, min(len(files), 4 * partitions(spark))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    file, crc, sums = PlaneReader(source), 0, []
                    for _, ids, ended in file.pieces():
                        crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes(), crc)
                        if ended:
                            sums.append(crc)
                            crc = 0
                lengths = file.lengths.astype(np.int64)
                begins = start + np.cumsum(lengths) - lengths
                for k in range(0, len(sums), READ_ROWS):
                    part = slice(k, k + READ_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[part], pa.int64()), pa.array(begins[part]), pa.array(lengths[part]), pa.array(sums[part], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts (null: empty) through files and back; repeated ids are ordered by a hash of their text."""
    import public_tokenizers

    return read_token_files(write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "planes")))
