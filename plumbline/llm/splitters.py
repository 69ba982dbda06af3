"""Sampled splitters: size-weighted key samples, quantile boundaries, exact range totals.

A key is a struct of longs. A range holds the keys from its boundary up to the next one.
What reaches the driver is a sample of bounded size and one row a range.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U53 = 1 << 53


@dataclass(frozen=True)
class Ranges:
    """Boundaries, ascending, and the exact weight and rows of each range."""

    fields: tuple[str, ...]
    boundaries: list[tuple[int, ...]]
    weights: list[int]
    rows: list[int]

    def of(self, key: Column) -> Column:
        """The number of boundaries at or below the key, by binary search over a literal array."""
        return range_of(self.fields, self.boundaries, key)


def range_of(fields: tuple[str, ...], boundaries: list[tuple[int, ...]], key: Column) -> Column:
    if not boundaries:
        return F.lit(0)
    low = -(2**63)
    text = lambda v: "CAST('-9223372036854775808' AS BIGINT)" if v == low else f"{v}L"
    rows = ",".join("named_struct(" + ",".join(f"'{f}',{text(v)}" for f, v in zip(fields, b, strict=True)) + ")" for b in boundaries)
    found = F.expr(f"array({rows})")
    steps = [1 << k for k in reversed(range(len(boundaries).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(found, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at),
    )


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    """Keys at equal steps of the sampled weight; a sample is (key, weight)."""
    sample = sorted(sample)
    total, seen, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        seen += w
        if len(out) + 1 < parts and seen >= total * (len(out) + 1) / parts:
            out.append(key)
            while len(out) + 1 < parts and seen >= total * (len(out) + 1) / parts:
                out.append(key)  # one heavy key may fill several steps
    return sorted(set(out))


def _sample(rows: DataFrame, fields: tuple[str, ...], weight: str, total: int, wanted: int, seed: int) -> list[tuple]:
    """About ``wanted`` keys at most, each row with a chance in proportion to its weight."""
    chance = F.least(F.lit(1.0), F.col(weight) * F.lit(float(wanted)) / F.lit(float(max(total, 1))))
    u = F.pmod(F.xxhash64(*[F.col(f) for f in fields], F.lit(seed)), F.lit(U53)) / F.lit(float(U53))
    got = rows.where(u < chance).select(*fields, (F.col(weight) / chance).alias("_w")).collect()
    return [(tuple(r[f] for f in fields), r["_w"]) for r in got]


def sampled_ranges(rows: DataFrame, fields: tuple[str, ...], weight: str, n_ranges: int, sample_rows: int = 20_000) -> Ranges:
    """Split rows into about ``n_ranges`` ranges of equal weight; overfull ranges are sampled again and cut.

    Cutting goes on until no range holds over twice its share, or until those that do can't be cut, as all their
    rows have one key. Every round finds new boundaries, so it ends.

    ``rows`` is read once for the totals, once for each sample and once for the exact sums.
    """
    key = F.struct(*[F.col(f) for f in fields])
    total, n = rows.agg(F.sum(weight), F.count(F.lit(1))).first()
    if not n:
        return Ranges(fields, [], [0], [0])
    bounds = _quantiles(_sample(rows, fields, weight, total, sample_rows, 0), n_ranges)
    share = max(1, total // n_ranges)
    for again in itertools.count(1):
        placed = rows.withColumn("_r", range_of(fields, bounds, key))
        got = {r[0]: (r[1], r[2]) for r in placed.groupBy("_r").agg(F.sum(weight), F.count(F.lit(1))).collect()}
        over = {r: w for r, (w, c) in got.items() if w > 2 * share and c > 1}
        if not over:
            break
        inside = placed.where(F.col("_r").isin(list(over)))
        sample = _sample(inside, fields, weight, sum(over.values()), sample_rows, again)
        cut: dict[int, list] = {r: [] for r in over}
        edges = bounds
        for k, w in sample:
            cut[_find(edges, k)].append((k, w))
        more = {b for r, s in cut.items() if s for b in _quantiles(s, -(-over[r] // share) + 1)} - set(bounds)
        if not more:
            break
        bounds = sorted({*bounds, *more})
    count = len(bounds) + 1
    return Ranges(fields, bounds, [got.get(r, (0, 0))[0] for r in range(count)], [got.get(r, (0, 0))[1] for r in range(count)])


def _find(bounds: list[tuple], key: tuple) -> int:
    import bisect

    return bisect.bisect_right(bounds, key)
