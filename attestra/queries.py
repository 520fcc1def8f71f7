"""All registered queries of the library (without the training-data subpackage)."""

from __future__ import annotations

from .plans import behaviour, calibration, comparison, contrasts, evidence, fusing, linkage, models, records, selections, sequences, streams  # noqa: F401
from .plans.registry import QUERIES, SQL  # noqa: F401
