"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF vectors (document counts over all documents). A distributed randomised SVD gives
their latent space. Windows of every document are projected into it and compared by cosine; each that comes near a
passage goes through a longest-common-subsequence check and an answer check on the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, unused
from .tokens import segments, together

#: Candidates: cosine to a passage, as a share of the cosine that its own text would have. Then the share of the
#: passage's words found in order, and the share of its answer's words found near by.
MIN_COSINE, MIN_LCS, MIN_ANSWER = 0.3, 0.6, 0.5
RANK, OVERSAMPLE, POWER_ROUNDS = 256, 8, 2
#: Passages are searched in blocks of about so many bytes (two thousand usual passages), which bounds what is
#: broadcast; their words are counted for so many blocks at once.
BLOCK_BYTES, COUNTED_BLOCKS = 1 << 19, 8
#: Words a window: a passage meets the shortest that holds it; one over the longest is looked for in pieces of that length.
WIDTHS = (16, 32, 64)
#: Words of a document whose windows are projected at once.
SEGMENT_WORDS = 1 << 11
#: Signs that often stand behind a word, and the words of a vocabulary up to which their spellings are kept.
USUAL_SIGNS, SPELLED_WORDS = ".,;:!?", 1 << 17
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def word(chunk: str) -> str:
    """A chunk between white space, case-folded, without signs at its ends."""
    return _ENDS.sub("", chunk.casefold())


class Numbers:
    """Numbers of a text's words: a word's place in the vocabulary, its size for any other word; signs alone have none.

    Known words and those with a usual sign behind them are looked up as they stand in the case-folded text; only
    what has other signs is taken apart, and no other word is kept.
    """

    def __init__(self, vocab: dict[str, int]):
        self.vocab, self.other = vocab, len(vocab)
        self.spelled = {w + sign: k for w, k in vocab.items() for sign in ("", *USUAL_SIGNS)} if len(vocab) <= SPELLED_WORDS else vocab

    def numbered(self, text: str) -> np.ndarray:
        chunks = text.casefold().split()
        ids = np.fromiter(map(self.spelled.get, chunks, repeat(self.other)), np.int32, len(chunks))
        vocab, other = self.vocab, self.other
        for i in np.flatnonzero(ids == other).tolist():
            if not (c := chunks[i]).isalpha():
                w = c[:-1] if c[:-1].isalpha() and not c[-1].isalnum() else _ENDS.sub("", c)
                ids[i] = vocab.get(w, other) if w else -1
        return ids

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in one row, and how many each text has; chunks of signs alone are left out."""
        parts = [[self.numbered(s) for s in segments(t or "")] for t in texts]
        ids = np.concatenate([x for p in parts for x in p]) if parts else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(texts)), [sum(map(len, p)) for p in parts])
        real = ids >= 0
        return ids[real], np.bincount(row[real], minlength=len(texts))


def words(text: str) -> list[str]:
    return [w for c in text.split() if (w := word(c))]


def answer_words(item: str, answer: str | None) -> list[str]:
    """The words of the answer; without one, of the passage's last sentence, or its last words if that is short."""
    if answer and words(answer):
        return words(answer)
    last = words(re.split(r"(?<=[.!?])\s+", item.strip())[-1])
    return last if len(last) >= 4 else words(item)[-8:]


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one big integer a row."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    state = row
    for y in b.tolist():
        m = where.get(y)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


@dataclass
class Index:
    """What workers need for one block of passages; its size grows with their words (BLOCK_BYTES, RANK).

    A row of ``latent`` is a passage, or a piece of a long one: ``owner`` is its passage, ``offset`` where the
    piece begins there, ``width`` the words of the windows that it is compared with. Where there are no more rows
    than dimensions, ``near`` has the product of both tables, a word's share in the likeness to each row, so that
    a window's likenesses are sums. Words outside the passages
    have the number len(vocab), the filling behind a text the next one.
    """

    vocab: dict[str, int]
    items: list[int]
    passages: list[np.ndarray]
    answers: list[np.ndarray]
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    project: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    near: np.ndarray | None = None
    own: np.ndarray = field(default_factory=lambda: np.zeros(0))
    norm: np.ndarray = field(default_factory=lambda: np.zeros(0))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    width: np.ndarray = field(default_factory=lambda: np.zeros(0, int))


# ---- the index ------------------------------------------------------------------------------------------------------


def document_counts(docs: DataFrame, text_col: str, known: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each of these words stands, over all documents, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers({w: k for k, w in enumerate(shared.value)})
        total, n, base = np.zeros(numbers.other, np.int64), 0, np.int64(numbers.other + 1)
        for b in batches:
            for run in together(b.column(0).to_pylist()):
                n += len(run)
                ids, size = numbers.of(run)
                row = np.repeat(np.arange(len(run)), size)
                inside = ids < numbers.other
                keys = np.sort(row[inside] * base + ids[inside])
                keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
                total += np.bincount(keys % base, minlength=numbers.other)[: numbers.other]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *total[at].tolist()], pa.int64())], ["w", "n"])

    got = {r.w: r.n for r in docs.select(text_col).mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {w: got.get(k, 0) for k, w in enumerate(known)}, got.get(-1, 0)


def _weighted(words_: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = np.unique(words_, return_counts=True)
    return at, (tf * idf[at]).astype(np.float32)


def latent_space(spark: SparkSession, rows: list[np.ndarray], idf: np.ndarray, rank: int = RANK, rounds: int = POWER_ROUNDS) -> np.ndarray:
    """Right singular vectors of the rows' TF-IDF matrix A by a distributed randomised SVD; a line for each word.

    The rows of A lie in partitions. Each task sends its part of A'(A Q) for the words that it holds, and the sums
    are made orthogonal on the driver. A block's words bound Q and all that is sent (BLOCK_BYTES, RANK).
    """
    n, width = len(idf), min(rank + OVERSAMPLE, len(idf), max(1, len(rows)))
    sc = spark.sparkContext
    parts = -(-len(rows) // 256)
    table = spark.createDataFrame([(k % parts, bytes(p.astype("<i4").tobytes())) for k, p in enumerate(rows)], "part int, words binary").repartition(parts, "part")
    weights = sc.broadcast(idf)
    q = np.random.default_rng(7).standard_normal((n, width)).astype(np.float32)

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        shared = sc.broadcast(q)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, q = weights.value, shared.value
            for b in batches:
                mine = [_weighted(np.frombuffer(raw, "<i4"), idf) for raw in b.column("words").to_pylist()]
                at = np.arange(q.shape[1]) if gram else np.unique(np.concatenate([a for a, _ in mine]))
                out = np.zeros((len(at), q.shape[1]), np.float32)
                for a, x in mine:
                    y = x @ q[a]
                    if gram:
                        out += np.outer(y, y)
                    else:
                        out[np.searchsorted(at, a)] += np.outer(x, y)
                yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["at", "m"])

        total = np.zeros((q.shape[1] if gram else n, q.shape[1]))
        for r in table.mapInArrow(multiply, "at binary, m binary").collect():
            total[np.frombuffer(r.at, "<i4")] += np.frombuffer(r.m, np.float32).reshape(-1, q.shape[1])
        shared.unpersist()
        return total

    for _ in range(rounds):
        q = np.linalg.qr(product(q, False))[0].astype(np.float32)
    value, vector = np.linalg.eigh(product(q, True))
    keep = np.argsort(-value)[:rank]
    keep = keep[value[keep] > 1e-9 * max(1e-30, value.max(initial=0))]
    return q.astype(float) @ vector[:, keep]


def build_index(spark: SparkSession, items: list[tuple[int, str, str | None]], counts: dict[str, int], n: int, rank: int = RANK) -> Index | None:
    """``items``: (number, text, answer or None); ``counts``: of n documents, how many hold each word. None when no passage has a word."""
    told = [(i, words(t), answer_words(t, a)) for i, t, a in items if t]
    told = [x for x in told if x[1]]
    if not told:
        return None
    vocab = {w: k for k, w in enumerate(sorted({w for _, ws, _ in told for w in ws}))}
    other = len(vocab)
    passages = [np.array([vocab[w] for w in ws], np.int32) for _, ws, _ in told]
    # a word that only the answer has is in no document's numbers; it counts as not found
    answers = [np.unique(np.array([vocab.get(w, other + 1) for w in a], np.int32)) for *_, a in told]
    index = Index(vocab, [i for i, *_ in told], passages, answers)
    idf = np.log((n + 2) / (np.array([counts[w] for w in vocab]) + 1))
    # words that no passage has aren't counted; they weigh what a passage's word weighs on average, however large n is
    index.idf = np.append(idf, [np.mean(idf[np.concatenate(passages)]), 0.0])
    cuts = [(i, at) for i, p in enumerate(passages) for at in pieces(len(p))]
    index.owner, index.offset = np.array(cuts).T
    parts = [passages[i][at : at + WIDTHS[-1]] for i, at in cuts]
    index.width = np.array([next((w for w in WIDTHS if w >= len(p)), WIDTHS[-1]) for p in parts])
    basis = latent_space(spark, parts, idf, rank)
    index.project = np.vstack([basis * idf[:, None], np.zeros((2, basis.shape[1]))]).astype(np.float32)
    index.latent = np.array([index.project[p].sum(0) for p in parts], np.float32)
    size = np.linalg.norm(index.latent, axis=1)
    index.norm = np.array([np.sqrt(square_norms(index.idf, p[None])[0]) for p in parts])
    index.own = size / np.maximum(index.norm, 1e-9)
    index.latent = index.latent / np.maximum(size, 1e-9)[:, None]
    if len(index.latent) <= 2 * index.project.shape[1]:
        order = np.argsort(index.width, kind="stable")  # rows by width: longer windows need the later columns alone
        for name in ("owner", "offset", "width", "own", "norm", "latent"):
            setattr(index, name, getattr(index, name)[order])
        index.near = np.ascontiguousarray(index.project @ index.latent.T)
    return index


def pieces(n: int) -> list[int]:
    """Where the pieces of a passage of n words begin; the last one ends with it."""
    longest = WIDTHS[-1]
    return sorted({*range(0, max(n - longest, 0) + 1, longest), max(n - longest, 0)})


def square_norms(idf: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of the TF-IDF vector of each row of word numbers; words outside the passages count as all different, filling as nothing."""
    rows = np.sort(windows, axis=1)
    at = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = (rows[:, 1:] != rows[:, :-1]) | (rows[:, 1:] == len(idf) - 2)
    nth = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
    return (idf[rows] ** 2 * (2 * nth + 1)).sum(1)  # a square is the sum of the odd numbers below it


# ---- the search -----------------------------------------------------------------------------------------------------


def stretches(n: int) -> list[tuple[int, int, int]]:
    """(begin, words, room) of the stretches of a text of n words: windows begin in one and end in its room."""
    out = []
    for b in range(0, n, SEGMENT_WORDS):
        size = min(n - b, SEGMENT_WORDS + WIDTHS[-1])
        last = n - b <= SEGMENT_WORDS
        out.append((b, size, -(-(size + (WIDTHS[-1] - 4) * last) // 16) * 16))
        if last:
            break
    return out


def candidates(index: Index, ids: np.ndarray, sizes: np.ndarray, min_cosine: float = MIN_COSINE) -> tuple[np.ndarray, ...]:
    """(text, passage, start, piece, cosine) of all windows near a passage or a piece of it, by text, passage and falling cosine.

    ``ids`` are the word numbers of several texts, ``sizes`` how many each has. Windows of w words begin every
    w / 4 words. What a window has besides the passage makes it weigh as much as the passage at most: a passage
    that stands whole in a window is near it, whatever surrounds it.
    """
    begins = np.cumsum(sizes) - sizes
    cut = [(d, b, size, room) for d, n in enumerate(sizes.tolist()) for b, size, room in stretches(n)]
    found: list[tuple[np.ndarray, ...]] = []
    while cut:
        held, k = 0, 0
        while k < len(cut) and (k == 0 or held + cut[k][3] <= 2 * SEGMENT_WORDS):
            held += cut[k][3]
            k += 1
        mine, cut = cut[:k], cut[k:]
        found.append(_near(index, ids, begins, sizes, mine, held, min_cosine))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)
    text, passage, start, piece, cos = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((piece, start, -cos, passage, text))
    return text[order], passage[order], start[order], piece[order], cos[order]


def _near(index: Index, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, cut: list[tuple[int, int, int, int]], held: int, min_cosine: float) -> tuple[np.ndarray, ...]:
    filling = len(index.vocab) + 1
    row = np.full(held, filling, np.int32)
    text, at, left = (np.zeros(held // 4, np.int64) for _ in range(3))  # of every fourth word: its text, its place there, words from there on
    where = 0
    for d, b, size, room in cut:
        row[where : where + size] = ids[begins[d] + b : begins[d] + b + size]
        s = slice(where // 4, (where + room) // 4)
        text[s], at[s] = d, b + np.arange(0, room, 4)
        left[s] = np.where(np.arange(0, room, 4) < min(size, SEGMENT_WORDS), sizes[d] - at[s], 0)
        where += room
    four = row.reshape(-1, 4)
    table = index.project if index.near is None else index.near
    vectors = table[four[:, 0]]
    for k in range(1, 4):
        vectors += table[four[:, k]]
    weight = (index.idf[four] ** 2).sum(1)
    out: list[tuple[np.ndarray, ...]] = []
    gone = 0  # columns of shorter windows, which aren't summed any more
    for step, width in zip((1, 2, 4), WIDTHS, strict=True):
        if step > 1:
            vectors, weight = vectors[0::2] + vectors[1::2], weight[0::2] + weight[1::2]
        those = np.flatnonzero(index.width == width)
        first = np.arange(0, len(text), step)
        rest = left[first]
        # a passage of this width has more than half of it, but for the shortest width
        ok = (rest > 0) & ((at[first] == 0) | (width == WIDTHS[0]) | (rest >= width // 2))
        ok[max(0, len(ok) - 3) :] = False  # no room behind; stretches end in filling, so nothing is there
        begin = np.flatnonzero(ok)
        if not len(those) or not len(begin):
            continue
        if index.near is None:
            cos = sum(vectors[begin + k] for k in range(4)) @ index.latent[those].T
        else:
            here = vectors[:, those[0] - gone : those[-1] + 1 - gone]
            pairs = here[:-1] + here[1:]
            cos = (pairs[:-2] + pairs[2:])[begin]
            vectors, gone = vectors[:, those[-1] + 1 - gone :], int(those[-1]) + 1
        light = np.sqrt(np.maximum(sum(weight[begin + k] for k in range(4)), 1e-12)).astype(np.float32)  # at most the window's norm
        least = np.float32(min_cosine) * index.own[those].astype(np.float32)
        norm = np.maximum(index.norm[those], 1e-6).astype(np.float32)
        r, c = np.nonzero(cos >= np.minimum(light[:, None], norm) * least)
        if not len(r):
            continue
        rows, back = np.unique(r, return_inverse=True)
        windows = row[4 * step * begin[rows][:, None] + np.arange(width)]
        size = np.sqrt(np.maximum(square_norms(index.idf, windows), 1e-12))[back]
        norm, own = np.maximum(index.norm[those[c]], 1e-6), index.own[those[c]]
        share = cos[r, c] / np.minimum(size, norm) / own
        near = share >= min_cosine
        f = first[begin[r[near]]]
        out.append((text[f], index.owner[those[c[near]]], at[f], those[c[near]], np.minimum(share * np.minimum(1.0, norm / size), 1.0)[near]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)


def check(index: Index, ids: np.ndarray, piece: int, start: int, min_answer: float = MIN_ANSWER, min_lcs: float = 0.0) -> tuple[float, float]:
    """(share of the passage in order, share of its answer's words) around a window; the order is looked for only where the words are enough."""
    item = index.owner[piece]
    passage, answer, begin, width = index.passages[item], index.answers[item], int(index.offset[piece]), int(index.width[piece])
    slack = max(8, len(passage) // 4)
    region = ids[max(0, start - begin - slack) : start + max(width, len(passage) - begin) + slack]
    there = set(region.tolist())
    told = sum(w in there for w in answer.tolist()) / len(answer) if len(answer) else 1.0
    if told < min_answer or sum(w in there for w in passage.tolist()) < min_lcs * len(passage):
        return 0.0, told
    return lcs_length(passage, region) / len(passage), told


def leaks(index: Index, ids: np.ndarray, sizes: np.ndarray, min_cosine: float = MIN_COSINE, min_lcs: float = MIN_LCS, min_answer: float = MIN_ANSWER) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(text, passage, cosine, lcs, answer, start) for each passage that a text holds: the nearest window that passes the checks.

    All windows over the cosine are checked, the nearest first, until one passes.
    """
    begins = np.cumsum(sizes) - sizes
    done = (-1, -1)
    for d, i, at, piece, cos in zip(*(c.tolist() for c in candidates(index, ids, sizes, min_cosine)), strict=True):
        if (d, i) == done:
            continue
        lcs, answer = check(index, ids[begins[d] : begins[d] + sizes[d]], piece, at, min_answer, min_lcs)
        if lcs >= min_lcs and answer >= min_answer:
            done = (d, i)
            yield d, i, cos, lcs, answer, at


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None,
               min_cosine: float = MIN_COSINE, min_lcs: float = MIN_LCS, min_answer: float = MIN_ANSWER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, word_start): a row for each document and passage it holds.

    Two map-only passes over whole texts where the passages fit one block; beyond it a search for each block and
    a count for each COUNTED_BLOCKS of them. Documents are never shuffled. Equal passages are searched once and
    reported each. Null and empty texts hold nothing, nor do passages without words. Null ids and repeated rows
    are reported row by row. Empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item long, cosine double, lcs double, answer double, word_start int"
    told = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("told"))
    told = told.withColumn("item", F.xxhash64("text", "told"))
    passages = told.where("text <> ''").groupBy("item").agg(F.first("text").alias("text"), F.first("told").alias("told"))
    size = passages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], schema)
    for k in range(0, blocks, COUNTED_BLOCKS):
        dealt = [sorted((r.item, r.text, r.told) for r in passages.where(F.pmod("item", F.lit(blocks)) == b).collect()) for b in range(k, min(blocks, k + COUNTED_BLOCKS))]
        known = sorted({w for block in dealt for _, t, _ in block for w in words(t)})
        if not known:
            continue
        counts, n = document_counts(docs, text_col, known)
        for block in dealt:
            index = build_index(spark, block, counts, n)
            if index is None:
                continue
            shared = spark.sparkContext.broadcast(vars(index))

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                index = Index(**shared.value)
                numbers = Numbers(index.vocab)
                for b in batches:
                    got: list[tuple] = []
                    ids_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                    at = 0
                    for run in together(texts):
                        ids, sizes = numbers.of(run)
                        got += [(ids_[at + d], index.items[i], *leak) for d, i, *leak in leaks(index, ids, sizes, min_cosine, min_lcs, min_answer)]
                        at += len(run)
                    cols = list(zip(*got, strict=True)) if got else [()] * 6
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item", "cosine", "lcs", "answer", "word_start"])

            out = out.unionByName(rows.mapInArrow(search, schema))
    return out.join(told.select("item", "item_id"), "item").select("doc_id", "item_id", "cosine", "lcs", "answer", "word_start")


def decontamination_stage(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents without a leaked passage, with the columns of ``docs``, whatever their names.

    The ids that go are found first, then taken out by an anti join: all rows of such an id go, and all rows
    with a null id if one of them leaks.
    """
    gone = unused("gone", docs)
    found = staged(find_leaks(docs, benchmark, id_col).select(F.col("doc_id").alias(gone)).distinct(), "leaks")
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(gone)), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
