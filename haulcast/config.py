"""Run parameters shared by every dataset and query."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class EngineConfig:
    """``as_of`` plays the part of today; ``None`` means the newest order date in the source."""

    as_of: date | None = None
    backtest_weeks: int = 52
    horizon_weeks: int = 13
    lookback_days: int = 91
    train_lookback_days: int = 540
    test_days: int = 90
    recipe: str = "full"  # "simple": short hold-out rule, no recursive model future

    def __post_init__(self):
        if self.recipe not in ("full", "simple"):
            raise ValueError(f"unknown forecast recipe {self.recipe!r}")
        for name in ("backtest_weeks", "horizon_weeks", "lookback_days", "train_lookback_days", "test_days"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
