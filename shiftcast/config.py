"""Default parameters of the planning and forecasting operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The five task types, their handling time in minutes and how
# many pieces of work one agent handles at once.
TASK_DEFAULTS = {
    "calls": (5.0, 1.0),
    "emails": (8.0, 2.0),
    "outbound_ook": (6.0, 1.0),
    "outbound_omk": (6.0, 1.0),
    "outbound_nb": (4.0, 1.0),
}
TASKS = tuple(TASK_DEFAULTS)

# Wide volume column -> task. The total is a sum of the others
# and is never staffed by itself.
VOLUME_COLUMNS = {
    "call_volume": "calls",
    "email_count": "emails",
    "outbound_ook": "outbound_ook",
    "outbound_omk": "outbound_omk",
    "outbound_nb": "outbound_nb",
}
TOTAL_COLUMN = "outbound_total"

# Opening hours shown on dashboards (07:00 to 22:00).
BUSINESS_HOURS = tuple(range(7, 23))


@dataclass(frozen=True)
class CapacityConfig:
    service_level: float = 0.80
    wait_seconds: float = 20.0
    shrinkage: float = 0.30
    open_hour: int = 8
    close_hour: int = 20
    max_agents: int = 500
    interval_minutes: float = 60.0
    tasks: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(TASK_DEFAULTS))

    def override(self, **changes) -> "CapacityConfig":
        return replace(self, **changes)


@dataclass(frozen=True)
class ForecastConfig:
    horizon_days: int = 30
    test_days: int = 14
    min_train_hours: int = 168
    lag_hours: tuple[int, ...] = (1, 2, 3, 24, 48, 168)
    rolling_windows: tuple[int, ...] = (24, 48, 168)
    confidence: float = 0.95
    max_iter: int = 500
    patience: int = 50
    step_size: float = 0.05
    max_depth: int = 5
    seed: int = 42


CAPACITY = CapacityConfig()
FORECAST = ForecastConfig()
