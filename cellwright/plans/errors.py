"""Errors of the control plane; errors of single sources are rows, not exceptions."""


class PipelineError(Exception):
    """Base of all."""


class ConfigError(PipelineError):
    """A pipeline file or a setting is wrong; the message names it."""


class CredentialError(PipelineError):
    """A key stands in the open, or a file of secrets is under version control."""


class PlanError(PipelineError):
    """Stages do not form a plan."""


class CycleError(PlanError):
    """Stages need each other in a circle."""


class TypeMismatch(PlanError):
    """A stage gets what it does not accept."""


class ConformanceError(PlanError):
    """A stage does not keep provenance though the plan is strict."""


class ImageError(PipelineError):
    """An image is unknown or its manifest is wrong."""


class BackendError(PipelineError):
    """No such backend, or it cannot run."""
