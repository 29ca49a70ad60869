"""rowsentry: explainable data-quality rules compiled to lazy Spark DataFrames."""
