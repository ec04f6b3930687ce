"""Every operator over the driver tables, next to the SQL that must agree with it."""

from checks import identity_checks, sample_checks, stream_checks, tier_checks, verb_checks  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
