"""pollgauge: Spark operators for polled station feeds.

Read raw polls, cut them into continuous periods, detect and repair bad
readings, inject reproducible faults, build gap-safe features, and measure how
the faults change decisions and cost.
"""

from pollgauge.config import CostModel, FeedConfig, FrozenModel, FaultGrid

__all__ = ["CostModel", "FeedConfig", "FrozenModel", "FaultGrid"]
