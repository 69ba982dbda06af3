"""Typed refusals. A threshold violation always carries what was observed and what was asked for."""


class EngineError(Exception):
    """Base of everything this engine refuses."""


class SchemaError(EngineError):
    """The shape, the columns or the configuration are wrong."""


class LookaheadError(EngineError):
    """Two series that must be aligned are not."""


class UnitMismatchError(EngineError):
    """A measure was asked for in a unit that the input doesn't carry."""


class ThresholdViolation(EngineError):
    def __init__(self, message: str, observed=None, threshold=None):
        super().__init__(f"{message} (observed={observed}, threshold={threshold})")
        self.observed, self.threshold = observed, threshold


class TradeIntegrityError(ThresholdViolation):
    """A trade contradicts itself or its log."""


class InsufficientSampleError(ThresholdViolation):
    """Too few observations for the measure."""


class GridSparsityError(ThresholdViolation):
    """No rung of the calendar grid is dense enough."""


class CalendarCoverageError(ThresholdViolation):
    """The calendar doesn't cover the log."""


class RegimeSparsityError(ThresholdViolation):
    """A regime has too few observations."""


class OverfitInputError(InsufficientSampleError):
    """A matrix of trials is too small for the test."""
