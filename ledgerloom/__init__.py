"""Bookkeeping and practice-data operators on PySpark DataFrames."""
