"""recordloom: record-level data integration and analytics on PySpark DataFrames."""
