"""Log collection, search, statistics, alerting and retention on Spark DataFrames.

Operators are plain functions from DataFrames to a DataFrame. None of them keeps
session state, and none reads the clock: a reference time is always a parameter.
"""
