"""procframe: models of signals and byte strings, computed with Spark DataFrames."""
