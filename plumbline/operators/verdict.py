"""Declared preferences: cumulative prospect value, certainty equivalents, ranking with required evidence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import InsufficientSampleError, SchemaError
from .grid import _sql


@dataclass(frozen=True)
class Preferences:
    """The published estimates of cumulative prospect theory."""

    alpha: float = 0.88
    beta: float = 0.88
    loss_aversion: float = 2.25
    gamma: float = 0.61
    delta: float = 0.69
    reference: float = 0.0

    def __post_init__(self) -> None:
        if min(self.alpha, self.beta, self.loss_aversion, self.gamma, self.delta) <= 0:
            raise SchemaError("preferences must be positive")

    @property
    def is_neutral(self) -> bool:
        return self.alpha == self.beta == self.loss_aversion == self.gamma == self.delta == 1


def _weight(p: str, c: float) -> str:
    p = f"least(greatest({p}, 0e0), 1e0)"
    if c == 1:
        return p
    return f"(power({p}, {c}e0) / power(power({p}, {c}e0) + power(1e0 - {p}, {c}e0), 1e0 / {c}e0))"


def weights_sql(x: Preferences) -> str:
    """(candidate, x, weight, value) of each outcome: losses weigh from the worst, gains from the best; zero is a gain."""
    return f"""
SELECT candidate, x, CASE WHEN x < 0 THEN {_weight("i / n", x.delta)} - {_weight("(i - 1e0) / n", x.delta)} ELSE {_weight("j / n", x.gamma)} - {_weight("(j - 1e0) / n", x.gamma)} END AS weight,
       CASE WHEN x >= 0 THEN power(x, {x.alpha}e0) ELSE -{x.loss_aversion}e0 * power(-x, {x.beta}e0) END AS value
FROM (SELECT candidate, x, CAST(count(*) OVER (PARTITION BY candidate) AS DOUBLE) AS n,
             CAST(row_number() OVER (PARTITION BY candidate ORDER BY x) AS DOUBLE) AS i, CAST(row_number() OVER (PARTITION BY candidate ORDER BY x DESC) AS DOUBLE) AS j
      FROM (SELECT candidate, outcome - {x.reference}e0 AS x FROM {{outcomes}}) o) r"""


def values_sql(x: Preferences) -> str:
    return f"""
SELECT candidate, v AS cpt_value, CASE WHEN v >= 0 THEN power(v, 1e0 / {x.alpha}e0) ELSE -power(-v / {x.loss_aversion}e0, 1e0 / {x.beta}e0) END + {x.reference}e0 AS certainty_equivalent
FROM (SELECT candidate, sum(weight * value) AS v FROM {{weighted}} GROUP BY candidate) s"""


def decision_weights(outcomes: DataFrame, preferences: Preferences = Preferences()) -> DataFrame:
    return _sql(outcomes, weights_sql(preferences), outcomes=outcomes)


def certainty_equivalents(outcomes: DataFrame, preferences: Preferences = Preferences()) -> DataFrame:
    """(candidate, cpt_value, certainty_equivalent) from outcomes (candidate, outcome)."""
    return _sql(outcomes, values_sql(preferences), weighted=decision_weights(outcomes, preferences))


@dataclass(frozen=True)
class Candidate:
    name: str
    outcomes: DataFrame
    sections: frozenset[str] = field(default_factory=frozenset)


def rank(candidates: list[Candidate], preferences: Preferences = Preferences(), requirements: tuple[str, ...] = C.DEFAULT_RANKING_REQUIREMENTS) -> dict:
    """Best certainty equivalent first, names in order on ties. Without its required sections a candidate gets no number."""
    if not candidates:
        raise InsufficientSampleError("nothing to rank", 0, 1)
    if len({c.name for c in candidates}) < len(candidates):
        raise SchemaError("candidates' names repeat")
    ranked, unranked, frame = [], [], None
    for c in candidates:
        missing = [r for r in requirements if r not in c.sections]
        if missing:
            unranked.append({"name": c.name, "certainty_equivalent": None, "cpt_value": None, "rankable": False, "blocking_sections": missing, "reason": "missing: " + ", ".join(missing)})
            continue
        rows = c.outcomes.select(F.lit(c.name).alias("candidate"), "outcome")
        frame = rows if frame is None else frame.unionByName(rows)
    if frame is not None:
        for r in certainty_equivalents(frame, preferences).collect():
            ranked.append({"name": r.candidate, "certainty_equivalent": r.certainty_equivalent, "cpt_value": r.cpt_value, "rankable": True, "blocking_sections": [], "reason": None})
    ranked.sort(key=lambda v: (-v["certainty_equivalent"], v["name"]))
    return {"ranked": ranked, "unrankable": sorted(unranked, key=lambda v: v["name"]), "requirements": list(requirements)}
