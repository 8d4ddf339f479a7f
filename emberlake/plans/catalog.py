"""All queries of the library (the training-data subpackage registers its own)."""

from emberlake.plans import extended, relational, signals, wallets  # noqa: F401
from emberlake.plans.registry import ORACLES, QUERIES  # noqa: F401
