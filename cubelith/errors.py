"""Errors of the engine, by what was asked for."""


class CubeError(ValueError):
    """Base of all."""


class GridError(CubeError):
    """Grids are malformed or do not agree."""


class PlanError(CubeError):
    """An operation is not possible on this cube."""


class ReduceUnsupported(CubeError):
    """Unknown reduction, or one that the given axes do not allow."""


class FocalPlacement(CubeError):
    """A neighbourhood operation where there is no neighbourhood."""


class WarpUnsupported(CubeError):
    """A resampling that is not known."""


class WriteError(CubeError):
    """Values or targets that a sink can't take."""


class GradUnsupported(CubeError):
    """A loss whose gradient can't be expressed."""


class StacError(CubeError):
    """A source table that is malformed."""


class OptionError(CubeError):
    """An unknown option or value."""
