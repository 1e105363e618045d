"""Analytic table operators for Spark DataFrames.

Every operator is a plain function from DataFrame to DataFrame; see the
README for the module map and the scale rules all of them follow.
"""
