"""A source-code context engine and training-data operators on PySpark."""
