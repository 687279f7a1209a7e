"""Spark-native supply-chain analytics: Bronze to Silver to Gold, forecasts, late risk, metrics."""

from haulcast.config import EngineConfig
from haulcast.workspace import Workspace

__all__ = ["EngineConfig", "Workspace"]
