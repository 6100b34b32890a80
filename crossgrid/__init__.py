"""crossgrid: evaluation, composite-index and group-comparison analytics on Spark DataFrames."""
