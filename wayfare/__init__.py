"""Wayfare: discrete-choice analytics at population scale on Spark DataFrames."""
