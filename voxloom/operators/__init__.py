"""Operators over calls: every one takes DataFrames and returns one."""
