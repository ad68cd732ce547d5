"""Heliograph: a PySpark-native engine for time-stamped readings, predictions and their payloads."""

from heliograph.session import build_session, cut

__all__ = ["build_session", "cut"]
