"""Immutable settings handed to operators; nothing here is read from module state at run time."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RiskProfile:
    """One generation of the daily-series and composite-score rules."""

    name: str
    # daily series
    window_rows: int
    frame_includes_today: bool
    min_periods: int
    min_history_days: int
    null_z_as_zero: bool
    z_threshold: float
    # composite score
    weight_negative: float
    weight_sentiment: float
    weight_anomaly: float
    high_cut: float
    medium_cut: float
    cuts_inclusive: bool
    # how old headlines lose weight
    normalised_recency: bool
    half_life_days: float = 3.0
    recency_scale_days: float = 30.0


# Thresholds, weights and cuts of the two rule sets.
CURRENT = RiskProfile(
    name="current",
    window_rows=7,
    frame_includes_today=False,
    min_periods=2,
    min_history_days=3,
    null_z_as_zero=False,
    z_threshold=2.0,
    weight_negative=40.0,
    weight_sentiment=35.0,
    weight_anomaly=25.0,
    high_cut=60.0,
    medium_cut=30.0,
    cuts_inclusive=True,
    normalised_recency=False,
)
LEGACY = RiskProfile(
    name="legacy",
    window_rows=7,
    frame_includes_today=True,
    min_periods=2,
    min_history_days=0,
    null_z_as_zero=True,
    z_threshold=1.5,
    weight_negative=35.0,
    weight_sentiment=25.0,
    weight_anomaly=40.0,
    high_cut=30.0,
    medium_cut=15.0,
    cuts_inclusive=False,
    normalised_recency=True,
)


def _parsed(env: Mapping[str, str], key: str, default, parse: Callable):
    raw = env.get(key)
    if raw is None:
        return default
    try:
        return parse(raw)
    except ValueError:
        log.warning("%s=%r is not a valid %s, keeping %s", key, raw, parse.__name__, default)
        return default


@dataclass(frozen=True)
class EngineConfig:
    """Run-level settings with their defaults; `from_env` applies the two overridable ones."""

    alert_threshold: float = 35.0
    alert_min_headlines: int = 5
    refresh_interval_minutes: int = 60
    max_articles_per_entity: int = 20
    max_age_days: int = 7
    score_batch_size: int = 32
    profile: RiskProfile = CURRENT

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        env = os.environ if env is None else env
        return cls(
            alert_threshold=_parsed(env, "RISK_ALERT_THRESHOLD", cls.alert_threshold, float),
            refresh_interval_minutes=_parsed(
                env, "REFRESH_INTERVAL_MINUTES", cls.refresh_interval_minutes, int
            ),
        )
