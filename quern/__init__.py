"""Analytics over stores of nested documents, built on PySpark DataFrames."""
