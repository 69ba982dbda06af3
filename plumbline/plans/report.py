"""The report: sections in a fixed order, each with its evidence or the reason why there is none."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import date, datetime

from ..errors import EngineError, SchemaError

RAN, SUPPRESSED, NOT_REQUESTED, FAILED = "RAN", "SUPPRESSED", "NOT_REQUESTED", "FAILED"
#: The sections in their order.
SECTIONS = ("trade_metrics", "calendar_metrics", "grid_selection", "resampling", "propfirm", "risk_tail", "drawdown_distribution", "risk_of_ruin", "track_record", "deflated_sharpe", "pbo", "spa", "regimes", "verdict")


@dataclass(frozen=True)
class Evidence:
    """A section that ran has a payload; any other has a reason."""

    name: str
    status: str
    payload: dict | None = None
    reason: str | None = None
    observed: object = None
    threshold: object = None
    warnings: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if (self.status == RAN) != (self.payload is not None) or (self.status != RAN and not self.reason):
            raise SchemaError(f"section {self.name}: a payload if it ran, else a reason")


def section(name: str, compute) -> Evidence:
    """Run a section; a typed refusal becomes a failed section, anything else is raised."""
    try:
        got = compute()
    except EngineError as e:
        return Evidence(name, FAILED, reason=str(e), observed=getattr(e, "observed", None), threshold=getattr(e, "threshold", None))
    payload, warnings = got if isinstance(got, tuple) else (got, ())
    return Evidence(name, RAN, payload, warnings=tuple(warnings))


@dataclass(frozen=True)
class Report:
    grid: dict
    parameters: dict
    provenance: dict
    panel: list[Evidence]
    warnings: list[str] = field(default_factory=list)
    #: SVG by section; part of the page alone.
    charts: dict[str, str] = field(default_factory=dict)

    def entry(self, name: str) -> Evidence:
        return next(e for e in self.panel if e.name == name)

    @property
    def sections_run(self) -> list[str]:
        return [e.name for e in self.panel if e.status == RAN]

    @property
    def sections_absent(self) -> list[str]:
        return [e.name for e in self.panel if e.status != RAN]

    def to_json(self) -> str:
        return json.dumps(plain({k: v for k, v in asdict(self).items() if k != "charts"}), sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"

    def write_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    def to_html(self) -> str:
        """One self-contained page: a table for each section, and its chart if it has one."""
        from html import escape

        show = lambda v: f"{v:.6g}" if isinstance(v, float) else escape(str(v))
        parts = ["<!doctype html><meta charset='utf-8'><title>Validation</title><body>"]
        for e in self.panel:
            rows = "".join(f"<tr><td>{escape(str(k))}</td><td>{show(v)}</td></tr>" for k, v in (e.payload or {"reason": e.reason}).items())
            notes = "".join(f"<p>{escape(w)}</p>" for w in e.warnings)
            parts.append(f"<h2>{escape(e.name)}: {e.status}</h2><table>{rows}</table>{self.charts.get(e.name, '')}{notes}")
        return "".join(parts) + "</body>\n"

    def to_latex(self) -> str:
        """A fragment of tables."""
        signs = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}
        tex = lambda v: "".join(signs.get(c, c) for c in (f"{v:.6g}" if isinstance(v, float) else str(v)))
        return "\n".join(
            f"\\subsection*{{{tex(e.name)}: {tex(e.status)}}}\n\\begin{{tabular}}{{ll}}\n" + "".join(f"{tex(k)} & {tex(v)} \\\\\n" for k, v in (e.payload or {"reason": e.reason}).items()) + "\\end{tabular}"
            for e in self.panel
        )


def plain(value: object) -> object:
    """Values that JSON knows; numbers that aren't finite and unknown kinds are refused."""
    if value is None or isinstance(value, (bool, str, int)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise SchemaError(f"a report holds no {value}")
        return value
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    raise SchemaError(f"a report holds no {type(value).__name__}")
