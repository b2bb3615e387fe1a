"""Job-market and candidate-matching analytics on PySpark DataFrames."""
