"""Every named query."""

from marquee.plans import anomaly, booking, catalog, payment, quality, recommend, revenue, schedule  # noqa: F401
from marquee.plans.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
