"""One registered query for each operator of the inventory."""

from . import aggregates, builds, jobs, projections, samples, selections, waveforms  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
