"""Plans as named relations in SQL: composed into one Spark plan, or written as SQL for another engine.

A relation's text names its inputs in braces. ``frame`` hands the text to Spark with those inputs as DataFrames,
so Catalyst sees the whole plan at once; ``duck`` writes the same relations as a WITH chain in DuckDB's words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .staging import staged

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Relation:
    """``sql`` for Spark; ``other`` is DuckDB's text where it is written apart. ``values`` fill <names>."""

    name: str
    sql: str
    inputs: tuple[Relation, ...] = ()
    values: tuple[tuple[str, object], ...] = ()
    other: str | None = field(default=None, compare=False)
    #: Small and read more than once: Spark writes it to the shared folder and reads it from there.
    stage: bool = field(default=False, compare=False)
    #: Makes the frame from the inputs' frames, by name, where an operator isn't SQL; ``other`` is then the oracle's text.
    run: Callable[..., DataFrame] | None = field(default=None, compare=False)

    def text(self, sql: str) -> str:
        for k, v in self.values:
            sql = sql.replace(f"<{k}>", str(v))
        return sql

    def frame(self, spark: SparkSession, sf_dir: str, made: dict | None = None) -> DataFrame:
        made = {} if made is None else made
        if self not in made:
            sql = self.text(self.sql)
            found = {r.name: r.frame(spark, sf_dir, made) for r in self.inputs}
            for t in TABLES:
                if f"{{{t}}}" in sql and t not in found:
                    found[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            df = self.run(**found) if self.run else spark.sql(sql, **{k: v for k, v in found.items() if f"{{{k}}}" in sql})
            made[self] = staged(df, self.name) if self.stage else df
        return made[self]

    def chain(self) -> list[Relation]:
        out: list[Relation] = []
        for r in self.inputs:
            out += [x for x in r.chain() if x not in out]
        return [*out, self]

    def duck(self) -> str:
        parts = self.chain()
        names = {r: f"{r.name}_{k}" for k, r in enumerate(parts)}
        body = []
        for r in parts:
            sql = r.text(r.other).replace("array(", "list_value(") if r.other else to_duck(r.text(r.sql))
            for x in r.inputs:
                sql = sql.replace(f"{{{x.name}}}", names[x])
            for t in TABLES:
                sql = sql.replace(f"{{{t}}}", t)
            body.append(f"{names[r]} AS MATERIALIZED ({sql})")
        return "WITH " + ",\n".join(body) + f"\nSELECT * FROM {names[self]}"


def even_rounds(sql: str) -> str:
    """Shift what ``round`` gets by a sliver, and take the sign from a zero that it gives.

    Profits are exact decimals, so plain rounding meets ties, which engines and orders of summation break differently.
    """
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, -1, at + 6
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            i += 1
        if comma < 0:
            at = i
            continue
        places = int(sql[comma + 1 : i - 1])
        new = f"(round ({sql[at + 6 : comma]} + 3.1e-{places + 4}, {places}) + 0e0)"
        sql = sql[:at] + new + sql[i:]
        at += 7
    return sql


_WORDS = [
    (r"\bunix_date\(", "date_diff('day', DATE '1970-01-01', "), (r"LEFT ANTI JOIN", "ANTI JOIN"), (r" div ", " // "), (r"\bpercentile\(", "quantile_cont("), 
    (r"\bexplode\(sequence\(", "unnest(generate_series("), (r"\bSTRING\b", "VARCHAR"), (r"\barray\(", "list_value("),
]


def to_duck(sql: str) -> str:
    for a, b in _WORDS:
        sql = re.sub(a, b, sql)
    return sql
