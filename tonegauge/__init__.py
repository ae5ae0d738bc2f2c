"""Headline sentiment and entity risk analytics as Spark DataFrame operators."""

from tonegauge.config import CURRENT, LEGACY, EngineConfig, RiskProfile

__all__ = ["CURRENT", "LEGACY", "EngineConfig", "RiskProfile"]
