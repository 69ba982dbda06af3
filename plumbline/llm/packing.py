"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces of one length are alike, so bins are solved as patterns (lengths in a bin) with how many bins are alike:
what the driver holds grows with the number of distinct lengths, not with the corpus. Best fit decreasing gives
the start; then underfull bins exchange one document for one, two for one, or move one, each time raising the
sum of squared fills, until the emptiest bins are empty and go.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, staged
from .tokens import CACHE_BYTES, worker_encoder

CAPACITY = 4096


# ---- bins ----------------------------------------------------------------------------------------------------------


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Patterns (lengths, descending) with their number of bins, as best fit in order of falling length fills them."""
    import bisect

    open_bins: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []
    done: dict[tuple, int] = defaultdict(int)

    def put(items: tuple, n: int) -> None:
        room = capacity - sum(items)
        if room == 0:
            done[items] += n
            return
        if room not in open_bins:
            bisect.insort(rooms, room)
            open_bins[room] = {}
        open_bins[room][items] = open_bins[room].get(items, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                n, rest = divmod(left, each)
                if n:
                    put((length,) * each, n)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[at]
            items, n = next(iter(open_bins[room].items()))
            each = room // length
            used = min(n, -(-left // each))
            full = min(used, left // each)
            for take, bins in ((each, full), (left - full * each, used - full)):
                if bins:
                    put(items + (length,) * take, bins)
            left -= full * each + (left - full * each if used > full else 0)
            if n == used:
                del open_bins[room][items]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(bisect.bisect_left(rooms, room))
            else:
                open_bins[room][items] = n - used
    for room in open_bins.values():
        for items, n in room.items():
            done[items] += n
    return dict(done)


def _pairs(items: tuple[int, ...]) -> list[tuple[int, ...]]:
    """What a bin can give: nothing, one document or two."""
    distinct = sorted(set(items))
    count = Counter(items)
    two = [(a, b) for i, a in enumerate(distinct) for b in distinct[i:] if a != b or count[a] > 1]
    return [(), *[(a,) for a in distinct], *two]


def local_search(bins: dict[tuple[int, ...], int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Exchange documents between underfull bins while the sum of squared fills rises; emptied bins go.

    The emptiest bin is the donor. It moves a document to another bin, swaps one for a smaller one, one for two
    that are smaller together, or two for one, taking the exchange that fills the other bin most. An exchange is
    made for as many pairs of alike bins as there are at once, so the work grows with the patterns, not with the
    bins. Each raises the sum of squared fills, so the search ends: when no donor's exchange does, or when as few
    bins are left as the tokens need.
    """
    bins = {k: n for k, n in bins.items() if n}
    fewest = -(-sum(sum(k) * n for k, n in bins.items()) // capacity)
    count = sum(bins.values())
    # what underfull patterns give, a row each: weight, documents, room and fill of the bin, whether the pattern is there
    gifts: list[tuple[tuple, tuple]] = []
    table = np.zeros((5, 1024), np.int64)
    rows: dict[tuple, tuple[int, int]] = {}
    tried: dict[tuple, int] = {}
    heap: list[tuple[int, tuple]] = []

    def add(items: tuple, n: int) -> None:
        nonlocal table
        if bins.get(items) == 1 and n > 0:
            tried.pop(items, None)  # alike bins may exchange with one another now
        bins[items] = bins.get(items, 0) + n
        if not bins[items]:
            del bins[items]
            if items in rows:
                table[4, slice(*rows.pop(items))] = 0
                tried.pop(items, None)
        elif items not in rows and sum(items) < capacity:
            give, at = _pairs(items), len(gifts)
            while at + len(give) > table.shape[1]:
                table = np.concatenate([table, np.zeros_like(table)], axis=1)
            gifts.extend((items, g) for g in give)
            rows[items] = (at, len(gifts))
            table[:, at : len(gifts)] = np.array([(sum(g), len(g), capacity - sum(items), sum(items), 1) for g in give]).T
            heapq.heappush(heap, (sum(items), items))

    for items in list(bins):
        add(items, 0)
    while count > fewest:
        if not heap:
            # patterns that came later may help those that were tried before
            heap = [(sum(k), k) for k in rows if tried.get(k, 0) < len(gifts)]
            heapq.heapify(heap)
            if not heap:
                break
        fill, donor = heap[0]
        if donor not in rows or tried.get(donor, 0) == len(gifts):
            heapq.heappop(heap)
            continue
        since = tried.get(donor, 0)
        weight, size, room, filled, there = table[:, since : len(gifts)]
        there = there.copy()
        if bins[donor] == 1:
            there[max(0, rows[donor][0] - since) : max(0, rows[donor][1] - since)] = 0
        best: tuple[int, int, tuple] = (0, -1, ())
        for mine in _pairs(donor)[1:]:
            gain = sum(mine) - weight
            # the squared fills rise by 2 gain (gain + fill of the other - fill of the donor)
            ok = (there > 0) & (gain > best[0]) & (gain <= room) & (size + len(mine) <= 3) & (gain + filled > fill)
            if ok.any():
                k = int(np.argmax(np.where(ok, gain, -1)))
                best = (int(gain[k]), k, mine)
        if best[1] < 0:
            tried[donor] = len(gifts)
            heapq.heappop(heap)
            continue
        other, gift = gifts[since + best[1]]
        n = bins[donor] // 2 if other == donor else min(bins[donor], bins[other])
        after, rest = list(other), list(donor)
        for x in gift:
            after.remove(x)
        for x in best[2]:
            rest.remove(x)
        add(donor, -n)
        add(other, -n)
        add(tuple(sorted([*after, *best[2]], reverse=True)), n)
        if left := tuple(sorted([*rest, *gift], reverse=True)):
            add(left, n)
        else:
            count -= n
    return bins


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    return local_search(best_fit_decreasing(counts, capacity), capacity)


def squared_fill(bins: dict[tuple[int, ...], int]) -> int:
    return sum(sum(k) ** 2 * n for k, n in bins.items())


# ---- documents -----------------------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Whole texts (null: empty) as ids with ``end_id`` appended, cut into pieces of ``capacity`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer, limit=cache_bytes), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=False):
                        out[c].append(v)
                    if with_ids:
                        out["ids"].append(part)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, {"piece": pa.int32(), "ids": pa.binary()}.get(c, pa.int64())) for c in out]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _slots(bins: dict[tuple[int, ...], int]) -> tuple[np.ndarray, ...]:
    """For each run of pieces of one length: length, first rank, pieces a bin, first sequence, first offset."""
    runs, base, taken = [], 0, defaultdict(int)
    for items, n in sorted(bins.items(), reverse=True):
        at = 0
        for length, each in sorted(Counter(items).items(), reverse=True):
            runs.append((length, taken[length], each, base, at))
            taken[length] += n * each
            at += length * each
        base += n
    return tuple(np.array(sorted(runs) or np.zeros((0, 5)), np.int64).T)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece its sequence_id and offset; offsets of a sequence run gapless from 0.

    Only a count of each length (at most ``capacity`` of them) reaches the driver. A piece's rank within its
    length comes from a window over chunks of that length, so no length is ever gathered in one task. Pieces are
    numbered as they are staged and dealt by that number, so that repeated rows spread over the chunks too.
    """
    spark = pieces.sparkSession
    chunks = max(64, 4 * partitions(spark))
    numbered = staged(pieces.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    keyed = numbered.withColumn("_chunk", F.pmod(F.xxhash64("_n", F.lit(5)), F.lit(chunks)).cast("int"))
    sizes = keyed.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("_size")).drop("_size")
    counts = {r[0]: r[1] for r in numbered.groupBy("length").count().collect()}
    shared = spark.sparkContext.broadcast(_slots(pack_lengths(counts, capacity)))
    order = Window.partitionBy("length", "_chunk").orderBy("_n")
    ranked = keyed.withColumn("_k", F.row_number().over(order)).join(before, ["length", "_chunk"])
    kept = [c for c in pieces.columns]
    ranked = ranked.select(*kept, (F.col("_before") + F.col("_k") - 1).alias("_rank"))
    names = [f.name for f in pieces.schema.fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, each, base, at = shared.value
        far = np.int64(1) << 48
        keys = lengths * far + first
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            run = np.searchsorted(keys, n * far + rank, side="right") - 1
            nth = rank - first[run]
            seq, offset = base[run] + nth // each[run], at[run] + nth % each[run] * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents.

    Null and empty texts are one piece, the end id alone; a text of any length is cut into as many as it takes.
    Null ids and repeated rows are packed row by row. An
    empty table gives an empty result. Other columns are ignored.
    """
    return pack_pieces(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, cache_bytes=cache_bytes), capacity)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, ids as little-endian unsigned 32-bit integers."""
    placed = pack_pieces(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x.ids))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
