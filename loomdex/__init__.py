"""Boolean full-text search and text-corpus processing, declared on PySpark DataFrames."""
