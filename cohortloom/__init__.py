"""Multi-cohort study operators on Spark DataFrames."""
