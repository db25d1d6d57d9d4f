"""Parameters of a feed, of the cost model, of the frozen score and of the fault grid."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

SECOND_US = 1_000_000

# Column names shared by all operators.  `us` is the poll time as epoch microseconds.
FEED = "feed_id"
STATION = "station_id"
PERIOD = "period_id"
US = "us"
BIKES = "num_bikes_available"
DOCKS = "num_docks_available"
SERIES = (FEED, STATION)
PERIOD_SERIES = (FEED, PERIOD, STATION)


@dataclass(frozen=True)
class FeedConfig:
    """Timing rules and detector thresholds.  Defaults fit a 60-second feed."""

    # Fixed values of the published method.
    cadence_s: int = 60
    lags: tuple[int, ...] = (1, 2, 5, 15)
    horizon: int = 120
    tolerance: float = 1.5
    max_gap_s: int = 120
    critical_at: int = 2
    max_flow_per_min: float = 1.0
    frozen_window_s: int = 3600
    repair_window_s: int = 180
    stale_age_s: int = 180
    report_cadence_s: int = 61
    report_gap_s: int = 120
    local_tz: str = "Europe/Rome"
    # None means: the shortest period that can hold one forecastable row.
    min_period_override_s: int | None = None
    # Long series are cut into time blocks of this length; a block is one window group.
    block_s: int = 86_400

    @property
    def min_period_s(self) -> int:
        if self.min_period_override_s is not None:
            return self.min_period_override_s
        return (max(self.lags) + self.horizon) * self.cadence_s

    @property
    def block_us(self) -> int:
        return self.block_s * SECOND_US

    @property
    def max_gap_us(self) -> int:
        return self.max_gap_s * SECOND_US

    def reach_us(self, steps: int) -> int:
        """Longest elapsed time that `steps` rows may span before a lag is void."""
        return int(steps * self.cadence_s * self.tolerance * SECOND_US)

    @property
    def lag_reach_us(self) -> int:
        return self.reach_us(max(self.lags))

    @property
    def row_hours(self) -> float:
        """Hours that one polled row stands for in the penalty."""
        return self.cadence_s / 3600

    @property
    def feature_columns(self) -> list[str]:
        return [f"{name}_lag{k}" for k in self.lags for name in ("bikes", "docks")]


# A feed polled every 15 minutes, with the same ratios as the 60-second defaults.
QUARTER_HOURLY = FeedConfig(
    cadence_s=900,
    horizon=4,
    max_gap_s=1350,
    repair_window_s=2700,
    report_cadence_s=900,
    report_gap_s=1800,
    min_period_override_s=6300,
)


@dataclass(frozen=True)
class CostModel:
    """Cost of missed critical rows and of dispatches."""

    # Fixed values of the published method: low, middle and high scenario.
    revenue_levels: tuple[float, ...] = (0.0, 0.5, 1.5)
    pickup_levels: tuple[float, ...] = (1.0, 1.94, 3.0)
    dispatch_levels: tuple[float, ...] = (10.0, 15.0, 25.0)
    sigma_levels: tuple[float, ...] = (0.2, 0.5, 0.8)
    level_names: tuple[str, ...] = ("low", "mid", "high")
    revenue_per_ride: float = 0.5
    pickup_rate_per_hour: float = 1.94
    dispatch: float = 15.0
    sigma: float = 0.5

    def penalty_per_row(self, row_hours: float) -> float:
        return row_hours * self.pickup_rate_per_hour * (1 - self.sigma) * self.revenue_per_ride


@dataclass(frozen=True)
class FrozenModel:
    """A frozen logistic score: coefficients stored as data, never refitted."""

    intercept: float
    coefficients: dict[str, float] = field(default_factory=dict)
    tau: float = 0.5

    def with_tau(self, tau: float) -> FrozenModel:
        return replace(self, tau=tau)


@dataclass(frozen=True)
class FaultGrid:
    """Six fault classes, four intensities each, five seeds."""

    # Fixed values of the published method.
    dropout: tuple[tuple[int, int], ...] = ((1, 300), (1, 900), (3, 1800), (5, 3600))
    frozen_s: tuple[int, ...] = (300, 900, 1800, 3600)
    stale_s: tuple[int, ...] = (60, 300, 900, 3600)
    capacity: tuple[int, ...] = (2, 5, 10, 20)
    jump: tuple[int, ...] = (2, 5, 10, 20)
    jump_rate: float = 0.05
    silent: tuple[int, ...] = (1, 2, 4, 8)
    silent_share: float = 0.05
    min_effect_s: int = 1800
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4)

    # The class names used in every result table.
    DROPOUT = "class1_dropout"
    FROZEN = "class2_frozen"
    STALE = "class3_stale"
    CAPACITY = "class4_capacity"
    JUMP = "class5_jump"
    SILENT = "class6_silent"

    def scaled(self, factor: int) -> FaultGrid:
        """The same grid for a feed polled `factor` times more slowly."""
        return replace(
            self,
            dropout=tuple((k, s * factor) for k, s in self.dropout),
            frozen_s=tuple(s * factor for s in self.frozen_s),
            stale_s=tuple(s * factor for s in self.stale_s),
            min_effect_s=self.min_effect_s * factor,
        )

    def rows(self) -> list[tuple]:
        """(class, intensity_idx, seed, stations, window_s, magnitude, rate), one per experiment."""
        spec: list[tuple] = []
        for i, (k, s) in enumerate(self.dropout):
            spec.append((self.DROPOUT, i, k, s, 0, 0.0))
        for i, s in enumerate(self.frozen_s):
            spec.append((self.FROZEN, i, 1, s, 0, 0.0))
        for i, s in enumerate(self.stale_s):
            spec.append((self.STALE, i, 0, s, 0, 0.0))
        for i, m in enumerate(self.capacity):
            spec.append((self.CAPACITY, i, 1, 0, m, 0.0))
        for i, m in enumerate(self.jump):
            spec.append((self.JUMP, i, 0, 0, m, self.jump_rate))
        for i, k in enumerate(self.silent):
            spec.append((self.SILENT, i, 0, 0, k, self.silent_share))
        return [(c, i, seed, k, s, m, r) for c, i, k, s, m, r in spec for seed in self.seeds]
