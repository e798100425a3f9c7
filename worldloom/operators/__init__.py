"""Operators: each takes DataFrames and returns DataFrames; nothing is collected unless its size was checked."""
