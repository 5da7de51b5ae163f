"""curafold: curate, split, screen and evaluate measurement data with Spark DataFrames."""
