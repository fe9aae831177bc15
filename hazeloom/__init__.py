"""Spark-native operators for gridded weather, energy-demand and outage tables.

Every operator is a function from DataFrames to a DataFrame; unit, time and
value columns are parameters, so it runs on any table of that shape.
"""
