"""Operators over findings, lines, code facts and graphs: functions from DataFrame to DataFrame."""
