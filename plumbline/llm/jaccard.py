"""Exact Jaccard join of documents on five-word shingles, with set-relation skipping.

Equal sets are one class. Two filters by shared shingles leave the sets that can have a partner at all. These go
into index lists of their prefix shingles, sorted by size and position: blocks whose size or position can't reach
the threshold are skipped. Lists are first walked along their most central members (linear work), and what these
comparisons link is one component. Only pairs across components are open then. Two sets that were counted against
the same set are settled from how they differ from it (see ``_difference_entries``); the others go through the
lists again. What stays open is counted exactly. Every link thus lies within one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, partitions, staged, unused
from .components import components

WORDS, PERCENT = 5, 75
#: Share of the hash space whose shingles the first filter looks at.
SAMPLE = 0.34
#: Each set is compared along the lists of its first shingles, so many times, before pairs across components are enumerated.
WALKED, WALKS = 6, 2
#: Up to this many sets (8 bytes each) their ids are broadcast to fetch their texts; beyond it they are joined.
BROADCAST_SETS = 1_000_000
#: So many of the commonest shingles come last in prefixes; a task sends those that it meets so often.
COMMON, OFTEN = 1 << 16, 8
#: Entries that a map task holds before it sends them on, and that a bucket is to hold (16 to 40 bytes each).
HELD, BUCKET_ENTRIES = 1 << 21, 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x ^ (x >> np.uint64(32))) * _M1


class Shingler:
    """The sorted distinct hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.hash = words, xxhash.xxh3_64_intdigest  # quicker than to look words up, as most words of a corpus are rare

    def of(self, text: str | None) -> np.ndarray:
        parts = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space cuts
        n = len(parts)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hash, parts), np.uint64, n)
        k = min(self.words, n)
        out = np.full(n - k + 1, k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = _mix(out * _M1 + h[j : n - k + 1 + j])
        return np.unique(out)


def signature(shingles: np.ndarray) -> int:
    """64 bits of the set, signed; two different sets among ten billion share one with a chance of a few in all."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def needed(a, b, percent: int = PERCENT):
    """Smallest overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


# ---- entries by shingle ---------------------------------------------------------------------------------------------


def _bucket(tokens: np.ndarray, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((_mix(tokens) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int32)


class _Sender:
    """Packs columns of entries into one binary row a bucket."""

    def __init__(self, buckets: int, names: list[str]):
        self.buckets, self.names, self.held, self.n = buckets, names, [], 0

    def add(self, *columns: np.ndarray) -> pa.RecordBatch | None:
        self.held.append(columns)
        self.n += len(columns[0])
        return self.flush() if self.n >= HELD else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.n = [], 0
        at = _bucket(columns[0], self.buckets)
        order = np.argsort(at, kind="stable")
        at = at[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        begins, ends = np.append(0, cuts), np.append(cuts, len(at))
        out = [pa.array(at[begins], pa.int32())]
        for c in columns:
            raw, size = c[order].tobytes(), c.itemsize
            out.append(pa.array([raw[a * size : b * size] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays(out, ["bucket", *self.names])


def _gather(table: pa.Table, names: list[str], kinds: list) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(n).to_pylist()), k) for n, k in zip(names, kinds, strict=True)]


def _lists(token: np.ndarray, sig: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries in order of token, rest and sig, each (token, sig) once, tokens of a single set left out; then the begins and sizes of the lists."""
    order = np.lexsort((sig, *rest[::-1], token))
    columns = [c[order] for c in (token, sig, *rest)]
    token, sig = columns[:2]
    by_sig = np.lexsort((sig, token))
    again = np.zeros(len(token), bool)
    again[by_sig[1:]] = (token[by_sig[1:]] == token[by_sig[:-1]]) & (sig[by_sig[1:]] == sig[by_sig[:-1]])
    columns = [c[~again] for c in columns]
    token = columns[0]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(token)))
    keep = np.repeat(size > 1, size)
    size = size[size > 1]
    return (*[c[keep] for c in columns], np.append(0, np.cumsum(size))[:-1].astype(np.int64), size)


def shared_counts(rows: DataFrame, entries: Callable, buckets: int) -> DataFrame:
    """(sig, shared, weight): how many of a set's sent shingles stand in another set too, and in how many sets these stand.

    ``entries`` yields (tokens, sig) of batches.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets, ["token", "sig"])
        for tokens, sig in entries(batches):
            if len(tokens) and (full := out.add(tokens, np.full(len(tokens), sig, np.int64))) is not None:
                yield full
        if (full := out.flush()) is not None:
            yield full

    def count(table: pa.Table) -> pa.Table:
        _, sig, _, size = _lists(*_gather(table, ["token", "sig"], [np.uint64, np.int64]))
        found, at, n = np.unique(sig, return_inverse=True, return_counts=True)
        weight = np.bincount(at, np.repeat(size, size), len(found)).astype(np.int64)
        return pa.table({"sig": pa.array(found, pa.int64()), "shared": pa.array(n, pa.int64()), "weight": pa.array(weight)})

    sent = rows.mapInArrow(send, "bucket int, token binary, sig binary")
    return sent.groupBy("bucket").applyInArrow(count, "sig long, shared long, weight long").groupBy("sig").agg(F.sum("shared").alias("shared"), F.sum("weight").alias("weight"))


def _sampled(tokens: np.ndarray) -> np.ndarray:
    return tokens[: int(np.searchsorted(tokens, np.uint64(int(SAMPLE * 2**64))))]


# ---- lists ----------------------------------------------------------------------------------------------------------


def common_shingles(sets: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, their places by falling count) of at most ``most`` shingles that many sets hold.

    Tasks count their own sets and send what they meet often. It only sets the order in which prefixes are taken:
    any one order for all sets gives every link, and common shingles last give short lists.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often], pa.int64())], ["t", "n"])

        for b in batches:
            for raw in b.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.uint64))
                n += len(held[-1])
                if n >= HELD:
                    yield send()
                    held, n = [], 0
        if held:
            yield send()

    got = sets.select("tokens").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(most).collect()
    tokens = np.array([r.t for r in got], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], order


def _prefix_entries(batches: Iterator[pa.RecordBatch], buckets: int, extra: list[str], percent: int, most: int | None = None, common=None) -> Iterator[pa.RecordBatch]:
    """Entries of each set's prefix; where lists are only walked, of its first ``most`` shingles.

    Shingles are in order of their hashes; with ``common`` those come last, the commonest at the very end.
    """
    late, place = common.value if common is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out = _Sender(buckets, ["token", "sig", "n", "pos", *extra])
    for b in batches:
        more = [b.column(c).to_pylist() for c in extra]
        for k, (sig, raw) in enumerate(zip(b.column("sig").to_pylist(), b.column("tokens").to_pylist(), strict=True)):
            tokens = np.frombuffer(raw, np.uint64)
            n = len(tokens)
            if len(late):
                at = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
                last = late[at] == tokens
                tokens = np.concatenate([tokens[~last], tokens[last][np.argsort(-place[at[last]], kind="stable")]])
            p = n - -(-percent * n // 100) + 1
            p = p if most is None else min(p, most)
            full = out.add(tokens[:p], np.full(p, sig, np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32), *[np.full(p, m[k], np.int64) for m in more])
            if full is not None:
                yield full
    if (full := out.flush()) is not None:
        yield full


def _can_reach(na, pa_, nb, pb, percent: int):
    """By size and position of a shared shingle that is the first the two share."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * small >= percent * large) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= needed(na, nb, percent))


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])) if len(low) else np.zeros(0, bool)
    return pa.table({"a": pa.array(low[new], pa.int64()), "b": pa.array(high[new], pa.int64())})


def walk_lists(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of each set with the most central member of a list, and of what lies outside that one's component with the most central there.

    The most central set of a group of near copies is what they were copied from: its shingles stand in most of
    the others. A group takes one pair for each set and list that is walked, not one for each two sets.
    """
    names, kinds = ["token", "sig", "n", "pos", "comp", "central"], [np.uint64, np.int64, np.int32, np.int32, np.int64, np.int64]
    token, sig, n, pos, comp, central, begin, size = _lists(*_gather(table, names, kinds))
    found_a, found_b = [sig[:0]], [sig[:0]]
    of_list = np.repeat(np.arange(len(begin)), size)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    rest = np.arange(len(token))
    for _ in range(2):
        if not len(rest):
            break
        order = rest[np.lexsort((sig[rest], -central[rest], of_list[rest]))]
        first = np.append(True, of_list[order][1:] != of_list[order][:-1])
        top = np.zeros(len(begin), np.int64)
        top[of_list[order[first]]] = order[first]
        lead = top[of_list[rest]]
        x, y = rest[(pos[rest] < WALKED) & (lead != rest)], lead[(pos[rest] < WALKED) & (lead != rest)]
        # sets that can't be linked with it are counted too, to be settled from their differences
        ok = (2 * np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y])) & (comp[x] != comp[y])
        found_a.append(sig[x[ok]])
        found_b.append(sig[y[ok]])
        rest = rest[comp[rest] != comp[lead]]
    return _unique_pairs(np.concatenate(found_a), np.concatenate(found_b))


def cross_lists(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of a list in different components without a set that both were counted against, as far as size and position leave them open."""
    names, kinds = ["token", "sig", "n", "pos", "comp", "home"], [np.uint64, np.int64, np.int32, np.int32, np.int64, np.int64]
    token, sig, n, pos, comp, home, begin, size = _lists(*_gather(table, names, kinds))
    if not len(token):
        return _unique_pairs(sig, sig)
    apart = lambda v: np.minimum.reduceat(v, begin) != np.maximum.reduceat(v, begin)
    mixed = apart(comp) & (apart(home) | (np.minimum.reduceat(home, begin) == 0))
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    found_a, found_b = [sig[:0]], [sig[:0]]
    for s, m in zip(begin[mixed].tolist(), size[mixed].tolist(), strict=True):
        e = s + m
        names_, count = np.unique(comp[s:e], return_counts=True)
        main = names_[np.argmax(count)]
        # a list is in order of size, then position: whole blocks on either side of the size limits are skipped
        for x in (np.flatnonzero(comp[s:e] != main) + s).tolist():
            lo = s + int(np.searchsorted(n[s:e], -(-percent * n[x] // 100)))
            hi = s + int(np.searchsorted(n[s:e], 100 * n[x] // percent, side="right"))
            y = np.flatnonzero((comp[lo:hi] != comp[x]) & ((home[lo:hi] != home[x]) | (home[x] == 0))) + lo
            y = y[_can_reach(n[x], pos[x], n[y], pos[y], percent)]
            found_a.append(np.full(len(y), sig[x]))
            found_b.append(sig[y])
    return _unique_pairs(np.concatenate(found_a), np.concatenate(found_b))


def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """What sets have beside their home set p (B) or lack of it (A), as keys of their own for each home, and the parts of the number below."""
    for batch in batches:
        keys, owns, shorts = [], [], []
        for home, raw, base in zip(*[batch.column(c).to_pylist() for c in ("home", "tokens", "home_tokens")], strict=True):
            x, p = np.frombuffer(raw, np.uint64), np.frombuffer(base, np.uint64)
            more, less = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
            with np.errstate(over="ignore"):
                place = _mix(np.array([home], np.int64).view(np.uint64))
                keys.append(np.concatenate([_mix(more ^ place), _mix(less ^ place ^ _M2)]).view(np.int64))
            owns.append(100 * len(less) + percent * len(more))
            shorts.append(percent * (len(x) + len(p)) - (100 + percent) * (len(p) - len(less)))  # over 0 where x isn't linked with p
        columns = [pa.array(keys, pa.list_(pa.int64())), pa.array(owns, pa.int64()), pa.array(shorts, pa.int64())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("sig", "home", "comp", "outside")], *columns], ["sig", "home", "comp", "outside", "keys", "own", "short"])


def usual_differences(differences: DataFrame) -> DataFrame:
    """(base, usual): keys that at least OFTEN differences from a home hold, by falling count."""
    counts = differences.select("home", F.explode("keys").alias("key")).groupBy("home", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    lists = counts.groupBy(F.col("home").alias("base")).agg(F.sort_array(F.collect_list(F.struct("n", "key")), asc=False).alias("usual"))
    return lists.select("base", F.col("usual.key").alias("usual"))


def _difference_entries(batches: Iterator[pa.RecordBatch], buckets: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Entries of what sets have beside their home set p (B) or lack of it (A).

    Sets x and y share |p| - |Ax| - |Ay| + |Ax and Ay| + |Bx and By| shingles. If x isn't linked with p, a link of
    x and y takes more than (100 |Ay| + percent |By|) / (100 + percent) shingles that both differences hold. So
    some shingle of y's difference, less that many, is in x's: y sends a prefix, the sets outside p's component all.
    Entries carry their position and the parts of that number, so that pairs can be left out by position too. What
    many sets of the home differ in (lines that a version of it lost) comes last, the commonest at the very end, so
    lists are short where they can still give pairs: any one order for all sets of a home gives every link.
    """
    out = _Sender(buckets, ["token", "sig", "comp", "role", "left", "part"])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("sig", "comp", "outside", "own", "short")]
        for sig, comp, outside, own, short, found, late in zip(*columns, batch.column("keys"), batch.column("usual"), strict=True):
            keys = found.values.to_numpy()
            last, mine, place = np.intersect1d(keys, late.values.to_numpy(), assume_unique=True, return_indices=True)
            keys = np.concatenate([np.delete(keys, mine), last[np.argsort(-place)]]).view(np.uint64)
            left = len(keys) - np.arange(len(keys), dtype=np.int32)
            for role, k, part in ((0, len(keys) - own // (100 + percent), own), (1, len(keys) if outside else 0, short)):
                if k and (full := out.add(keys[:k], np.full(k, sig, np.int64), np.full(k, comp, np.int64), np.full(k, role, np.int8), left[:k], np.full(k, part, np.int64))) is not None:
                    yield full
    if (full := out.flush()) is not None:
        yield full


def difference_lists(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of a set outside its home's component with a set of another component whose sent difference it meets early enough."""
    names, kinds = ["token", "sig", "comp", "role", "left", "part"], [np.uint64, np.int64, np.int64, np.int8, np.int32, np.int64]
    columns = _gather(table, names, kinds)
    order = np.lexsort((columns[3], columns[0]))
    token, sig, comp, role, left, part = (c[order] for c in columns)
    found_a, found_b = [sig[:0]], [sig[:0]]
    if len(token):
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        end = np.append(begin[1:], len(token))
        asked = np.add.reduceat(role.astype(np.int64), begin)
        apart = np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)
        for s, e, k in zip(*(v[apart & (asked > 0) & (asked < end - begin)].tolist() for v in (begin, end, asked)), strict=True):
            for x in range(e - k, e):
                y = np.flatnonzero(comp[s : e - k] != comp[x]) + s
                # what both still have from here on must reach the number that a link takes
                y = y[(100 + percent) * np.minimum(left[x], left[y]).astype(np.int64) >= part[x] + part[y]]
                found_a.append(np.full(len(y), sig[x]))
                found_b.append(sig[y])
    return _unique_pairs(np.concatenate(found_a), np.concatenate(found_b))


def count_overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap, na, nb, linked) of each pair, counted on the whole sets; staged."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over, na, nb = [], [], []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                over.append(int((both[1:] == both[:-1]).sum()))
                na.append(len(p))
                nb.append(len(q))
            o = np.array(over, np.int64)
            total = np.array(na, np.int64) + np.array(nb, np.int64) - o
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(o), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(100 * o >= percent * total)], ["a", "b", "overlap", "na", "nb", "linked"])

    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"))
    return staged(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(count, "a long, b long, overlap long, na long, nb long, linked boolean"), "overlaps")


# ---- the join -------------------------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links lead to.

    Null and empty texts and texts without words have the empty set and link with nothing. Repeated rows and
    copies are one class. A null id is reported with the component of its set (null if no id is known there).
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for b in batches:
            got = [make.of(t) for t in b.column(1).to_pylist()]
            sigs = pa.array([signature(s) if len(s) else None for s in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in got], pa.int64()), sigs, pa.array([len(_sampled(s)) for s in got], pa.int64())], ["doc_id", "n", "sig", "sampled"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        make, seen = Shingler(words), set()
        for b in batches:
            for t in b.column(0).to_pylist():
                s = make.of(t)
                if len(s) and (sig := signature(s)) not in seen:
                    if len(seen) < 1 << 19:
                        seen.add(sig)
                    yield _sampled(s), sig

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for b in batches:
            got = [s for t in b.column(0).to_pylist() if len(s := make.of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in got], pa.int64()), pa.array([len(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["sig", "n", "tokens"])

    def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for b in batches:
            for sig, raw in zip(b.column("sig").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                yield np.frombuffer(raw, np.uint64), sig

    def buckets_for(entries: int | None) -> int:
        """So many that a bucket holds about BUCKET_ENTRIES entries, whatever the corpus."""
        return max(256, 16 * partitions(spark), -(-(entries or 0) // BUCKET_ENTRIES))

    signed = staged(rows.mapInArrow(sign, "doc_id long, n long, sig long, sampled long"), "signed")
    classes = signed.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.max("n").alias("n"), F.max("sampled").alias("sampled"))

    # at most n - ceil(.75 n) shingles of a linked set are missing in its partner, whichever part of them is looked at
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    first = shared_counts(rows.select("text"), sample, buckets_for(signed.agg(F.sum("sampled")).first()[0]))
    able = staged(classes.join(first, "sig", "left").where(F.col("sampled") - F.coalesce("shared", F.lit(0)) <= spare).select("sig", "rep"), "able")
    ids = able.select(F.col("rep").alias("doc_id"))
    if able.count() <= BROADCAST_SETS:
        ids = F.broadcast(ids)
    fetched = rows.join(ids, rows.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
    sets = staged(fetched.mapInArrow(sets_of, "sig long, n long, tokens binary"), "sets")
    buckets = buckets_for(sets.agg(F.sum("n")).first()[0])
    second = shared_counts(sets.select("sig", "tokens"), all_tokens, buckets)
    central = (F.col("weight") * 1000 / F.col("n")).cast("long").alias("central")
    kept = staged(sets.join(second.withColumnRenamed("sig", "s"), F.col("sig") == F.col("s")).where(F.col("n") - F.col("shared") <= spare).select("sig", "n", "tokens", central).dropDuplicates(["sig"]), "kept-sets")
    discard(able, sets)

    entry = "bucket int, token binary, sig binary, n binary, pos binary"
    prefixes = lambda df, extra, most=None, common=None: df.select("sig", "tokens", *extra).mapInArrow(partial(_prefix_entries, buckets=buckets, extra=extra, percent=percent, most=most, common=common), entry + "".join(f", {c} binary" for c in extra))
    comps, known, counted = None, None, []
    for _ in range(WALKS):
        placed = kept.withColumn("comp", F.col("sig")) if comps is None else kept.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("root", "sig"))
        pairs = prefixes(placed, ["comp", "central"], 4 * WALKED).groupBy("bucket").applyInArrow(lambda t: walk_lists(t, percent), "a long, b long").distinct()
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        fresh = count_overlaps(pairs, kept, percent)
        counted.append(fresh)
        known = fresh if known is None else known.unionByName(fresh)
        if comps is not None:
            discard(comps)
        comps = components(known.where("linked").select("a", "b"))

    # a set's home: the most central one that it was counted against
    both = known.select(F.col("a").alias("sig"), F.col("b").alias("other")).union(known.select("b", "a"))
    home = both.join(kept.select(F.col("sig").alias("other"), "central"), "other").groupBy("sig").agg(F.max(F.struct("central", "other")).alias("h")).select("sig", F.col("h.other").alias("home"))
    placed = kept.select("sig", "tokens").join(comps.withColumnRenamed("node", "sig"), "sig", "left").join(home, "sig", "left")
    placed = staged(placed.select("sig", "tokens", F.coalesce("root", "sig").alias("comp"), F.coalesce("home", F.lit(0).cast("long")).alias("home")), "placed-sets")
    common = spark.sparkContext.broadcast(common_shingles(placed))  # COMMON shingles at most, 16 bytes each
    crossed = prefixes(placed, ["comp", "home"], common=common).groupBy("bucket").applyInArrow(lambda t: cross_lists(t, percent), "a long, b long")

    # homes with a set outside their component, from a row for each home and component; only these are joined with
    # all their sets, by a plain join whose hot side Spark can split
    bases = placed.select(F.col("sig").alias("base"), F.col("comp").alias("base_comp"), F.col("tokens").alias("home_tokens"))
    homes = placed.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("sets"))
    torn = homes.join(bases.drop("home_tokens"), (F.col("home") == F.col("base")) & (F.col("comp") != F.col("base_comp"))).select("base").distinct()
    torn_bases = staged(bases.join(torn, "base", "left_semi"), "torn-homes")
    beside = placed.join(torn_bases, F.col("home") == F.col("base")).select("sig", "home", "comp", (F.col("comp") != F.col("base_comp")).alias("outside"), "tokens", "home_tokens")
    differences = staged(beside.mapInArrow(partial(_differences, percent=percent), "sig long, home long, comp long, outside boolean, keys array<long>, own long, short long"), "differences")
    usual = staged(usual_differences(differences), "usual-differences")
    ordered = differences.join(usual, F.col("home") == F.col("base"), "left").withColumn("usual", F.coalesce("usual", F.expr("cast(array() as array<bigint>)")))
    differing = ordered.mapInArrow(partial(_difference_entries, buckets=buckets, percent=percent), "bucket int, token binary, sig binary, comp binary, role binary, left binary, part binary").groupBy("bucket").applyInArrow(lambda t: difference_lists(t, percent), "a long, b long")
    open_pairs = crossed.union(differing).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    late = count_overlaps(open_pairs, kept, percent)
    if late.where("linked").limit(1).count():
        discard(comps)
        comps = components(known.unionByName(late).where("linked").select("a", "b"))

    roots = comps.join(classes.select(F.col("sig").alias("node"), "rep"), "node")
    lowest = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(lowest, "root").select(F.col("node").alias("s"), "component_id")
    copies = classes.where("members > 1").join(linked.select("s"), F.col("sig") == F.col("s"), "left_anti").select(F.col("sig").alias("s"), F.col("rep").alias("component_id"))
    of_set = staged(linked.unionByName(copies), "set-components")
    discard(kept, placed, torn_bases, differences, usual, late, comps, *counted)
    out = signed.join(of_set, F.col("sig") == F.col("s"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicate_stage(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with its smallest id. Rows with null ids stay."""
    found = jaccard_components(docs)
    name = unused("gone", docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
