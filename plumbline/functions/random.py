"""Keyed uniforms: a draw depends on its key alone, never on partitioning or order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *key: Column | str) -> Column:
    """A double in [0, 1) from the first 32 bits of md5(seed|stream|key...)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def uniform_sql(seed: int, stream: str, *key: str) -> str:
    cast = " || '|' || ".join(f"CAST({k} AS STRING)" for k in key)
    return f"(CAST(conv(substr(md5('{seed}|{stream}|' || {cast}), 1, 8), 16, 10) AS DOUBLE) / 4294967296e0)"


def uniform_duck(seed: int, stream: str, *key: str) -> str:
    cast = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(CAST(CAST('0x' || substr(md5('{seed}|{stream}|' || {cast}), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296e0)"


def uniform_value(seed: int, stream: str, *key: object) -> float:
    text = "|".join([str(seed), stream, *map(str, key)])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32
