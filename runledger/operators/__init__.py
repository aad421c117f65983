"""Operators: functions from (tables, clock, parameters) to a lazy DataFrame."""
