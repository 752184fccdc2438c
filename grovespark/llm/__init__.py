"""Operators that prepare training text: one module for each.

Every operator takes DataFrames and column names and returns a DataFrame.
``registry`` holds the production queries and their SQL.
"""
