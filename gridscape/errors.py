"""Errors of the clustering engine, one class a cause."""

from __future__ import annotations


class GridscapeError(Exception):
    """Base of all."""


class InvalidInputData(GridscapeError, ValueError):
    """A feature is null, NaN or infinite, or there is no row."""


class DimensionMismatch(GridscapeError, ValueError):
    """A row's number of features isn't the model's."""


class NotFitted(GridscapeError, RuntimeError):
    """The model has nothing to score with yet."""


class AlreadyFitted(GridscapeError, RuntimeError):
    """A k-means estimator is fitted once."""


class InvalidLearningRate(GridscapeError, ValueError):
    """The learning rate is beyond 1.76."""


class InvalidClusterCount(GridscapeError, ValueError):
    """The number of clusters isn't between 1 and the number of rows (or units)."""


class InvalidInitMethod(GridscapeError, ValueError):
    """No such way of seeding."""


class InvalidMetric(GridscapeError, ValueError):
    """No such distance or score."""


class InsufficientData(GridscapeError, ValueError):
    """Fewer rows, maxima or labels than the operator needs."""


class PersistenceError(GridscapeError, OSError):
    """A stored model can't be read."""


class NoSharedFolder(GridscapeError):
    """spark.checkpoint.dir is unset on a cluster, whose executors don't see the driver's folders."""
