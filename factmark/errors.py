"""Refusals. A guard raises one of these before a plan is built on bad ground."""


class ResearchError(ValueError):
    """Input or parameters an operator cannot answer for."""


class IngestError(ResearchError):
    """A source file does not have the expected form."""


class PointInTimeError(ResearchError):
    """What was known when cannot be answered for this data."""


class LookAheadContamination(PointInTimeError):
    """Restated values were asked for without acknowledging what that means."""


class HoldoutViolation(ResearchError):
    """A request reaches into a protected period."""


class LeakageError(AssertionError):
    """A training row shares information with its test window."""


class LookAheadFactor(AssertionError):
    """A factor value moved when only later data changed."""
