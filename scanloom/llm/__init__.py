"""Training-data operators on Spark DataFrames.

Nothing outside this subpackage (and the pipeline script) imports it.
"""
