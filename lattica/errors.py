"""Exceptions of the engine."""


class LatticaError(Exception):
    """Base of all errors raised here."""


class ConfigError(LatticaError, ValueError):
    """A configuration doesn't have the required form."""


class WarehouseError(LatticaError):
    """A warehouse is inconsistent; ``problems`` lists all findings."""

    def __init__(self, message: str, problems: list[str] | None = None):
        super().__init__(message)
        self.problems = problems or []


class InvalidWarehouseId(LatticaError): ...


class ReportError(LatticaError): ...


class InvalidReportId(ReportError): ...


class UnsupportedGrain(ReportError): ...


class InvalidField(LatticaError): ...


class InvalidTechnical(LatticaError): ...


class InvalidDimensionValue(ReportError): ...


class DisallowedSQL(LatticaError): ...


class MaxFormulaDepth(LatticaError): ...


class MaxReportDepth(ReportError): ...


class QueryTimeout(ReportError): ...


class ExecutionKilled(ReportError): ...


class ExecutionLocked(ReportError): ...


class FailedKill(ReportError): ...


class QuestionError(LatticaError): ...
