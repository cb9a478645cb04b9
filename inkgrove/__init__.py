"""Document-store analytics on PySpark.

Every operator is a lazy function from DataFrames to a DataFrame, or from
Columns to a Column.  See README.md for the map of operators.
"""
