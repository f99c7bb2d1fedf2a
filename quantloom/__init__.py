"""quantloom: set-oriented numerical analytics on PySpark DataFrames."""
