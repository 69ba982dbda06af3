"""Symbols: contracts, tick sizes, currencies and the names that sources give them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaError


@dataclass(frozen=True)
class SymbolSpec:
    venue: str
    multiplier: float
    tick_size: float
    currency: str
    calendar: str
    contract_root: str = ""
    source_ids: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not (self.multiplier > 0 and self.tick_size > 0):
            raise SchemaError("multiplier and tick size must be positive")
        if len(self.currency) != 3 or not self.currency.isalpha():
            raise SchemaError(f"a currency has three letters, got {self.currency}")
        object.__setattr__(self, "currency", self.currency.upper())


@dataclass(frozen=True)
class SymbologyMap:
    symbols: dict[str, SymbolSpec]

    def __post_init__(self) -> None:
        if not self.symbols:
            raise SchemaError("no symbols")

    def names(self, source: str) -> dict[str, str]:
        """Each name that a source may use, its own or the canonical one; a name of two symbols is refused."""
        out: dict[str, str] = {}
        for symbol, spec in self.symbols.items():
            if own := spec.source_ids.get(source):
                if out.setdefault(own, symbol) != symbol:
                    raise SchemaError(f"{own} names both {out[own]} and {symbol}")
        return {s: s for s in self.symbols} | out

    def resolve(self, source: str, raw: str) -> str:
        try:
            return self.names(source)[raw]
        except KeyError:
            raise SchemaError(f"{source} knows no symbol {raw}") from None

    def as_map(self, source: str) -> Column:
        """The dimension as a literal map of the plan: symbols are configuration, a few hundred at most."""
        pairs = []
        for raw, symbol in sorted(self.names(source).items()):
            pairs += [F.lit(raw), F.struct(F.lit(symbol).alias("canonical"), F.lit(float(self.symbols[symbol].multiplier)).alias("multiplier"))]
        return F.create_map(*pairs)

    def tick_sizes(self) -> dict[str, float]:
        return {s: x.tick_size for s, x in self.symbols.items()}

    def require_single_currency(self, used: list[str]) -> str:
        found = sorted({self.symbols[s].currency for s in used})
        if len(found) != 1:
            raise SchemaError(f"one currency is needed, found {', '.join(found) or 'none'}")
        return found[0]


def load_symbology(path: str) -> SymbologyMap:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    try:
        return SymbologyMap({k: SymbolSpec(**v) for k, v in (raw.get("symbols") or {}).items()})
    except TypeError as e:
        raise SchemaError(f"symbology: {e}") from e
