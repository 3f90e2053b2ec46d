"""Panel engine: functions."""
