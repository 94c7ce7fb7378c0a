"""Part of the loomdex package: functions."""
