"""Declared decisions. They must equal those of the methods' published definitions."""

import math

MIN_TRADES = 30
MIN_PERIODS = 60
MIN_ACTIVE_FRACTION = 0.15
MAX_HOLDING_TO_PERIOD = 1.0
PNL_RTOL = 1e-6
MIN_BLOCK_SAMPLE_RATIO = 10.0
MIN_STATE_OBS = 20
EULER_MASCHERONI = 0.5772156649015329
BARRIER_CONTINUITY_CORRECTION = 0.5826
EXPECTED_MAX_DRAWDOWN_COEFFICIENT = math.sqrt(math.pi / 2)
NW_LAG_SELECTION_COEFFICIENT = 4.0
NW_LAG_SELECTION_EXPONENT = 2 / 9
NW_BARTLETT_BANDWIDTH_CONSTANT = 1.1447
DEFAULT_CONFIDENCE_LEVEL = 0.95
SPARSITY_KURTOSIS_ROOT = (9 - math.sqrt(45)) / 18
WEEKDAYS_PER_YEAR = 365.25 * 5 / 7
WEEKS_PER_YEAR = 365.25 / 7
MONTHS_PER_YEAR = 12.0
DEFAULT_TAIL_LEVEL = 0.95
MIN_TAIL_PATHS = 20
DEFAULT_CSCV_SPLITS = 16
DEFAULT_STATES_PER_AXIS = 3
DEFAULT_REGIME_WINDOW = 21
BLOCK_LENGTH_WARNING_THRESHOLD = 2.0
MAX_GAP_EXCESS_FRACTION = 0.02
#: Modal gap in days of a series -> its rung.
GAP_BANDS = {"DAILY": (1, 4), "WEEKLY": (5, 9), "MONTHLY": (26, 35)}
COST_TO_QUANTUM_FLOOR = 1.0
MULTIPLIER_QUANTUM_CEILING = 0.25
DEFAULT_RANKING_REQUIREMENTS = ("resampling", "deflated_sharpe")
CALENDAR_PADDING_DAYS = 7
DAY_NS = 86_400_000_000_000
JULIAN_YEAR_NS = 365.25 * DAY_NS
PERIODS = ("DAILY", "WEEKLY", "MONTHLY")
FIXED_INITIAL, CURRENT_EQUITY = "FIXED_INITIAL", "CURRENT_EQUITY"


def sparsity_kurtosis(p: float) -> float:
    """Kurtosis of a series that is one value with probability p and zero otherwise."""
    if not 0 < p < 1:
        raise ValueError(f"p must lie between 0 and 1, got {p}")
    return (1 - 3 * p * (1 - p)) / (p * (1 - p))


def dilution_ratio_annualised(active_fraction: float, active_sharpe: float) -> float:
    """Sharpe ratio of the whole grid over that of its active periods, each annualised at its own rate."""
    if not 0 < active_fraction <= 1:
        raise ValueError(f"an active fraction lies in (0, 1], got {active_fraction}")
    return (1 + (1 - active_fraction) * active_sharpe**2) ** -0.5


def dilution_ratio_per_period(active_fraction: float, active_sharpe: float) -> float:
    """The same ratio before annualising."""
    return dilution_ratio_annualised(active_fraction, active_sharpe) * math.sqrt(active_fraction)


def degenerate_annual_sharpe(years: float) -> float:
    """Annual Sharpe ratio of a series with one non-zero period, whatever its size."""
    if years <= 0:
        raise ValueError(f"years must be positive, got {years}")
    return years**-0.5


def pnl_atol(tick_size: float, multiplier: float, qty: float) -> float:
    """The profit of one tick, the tolerance of the coherence check."""
    if min(tick_size, multiplier, qty) <= 0:
        raise ValueError(f"tick size, multiplier and quantity must be positive, got {tick_size}, {multiplier}, {qty}")
    return tick_size * multiplier * qty
