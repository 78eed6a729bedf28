"""Errors of the clustering operators."""


class EmptyClusterError(ValueError):
    """No point is left to make another cluster from."""


class CannotSelectInitialCentersError(EmptyClusterError):
    """There are fewer (distinct) points than clusters asked for."""


class EmptySetError(ValueError):
    """A mean or deviation of no points."""


class NonFiniteError(ValueError):
    """A sum met a value that is not finite."""


class StoppedError(RuntimeError):
    """The work was cancelled."""
