"""facsimile: profile, protect, synthesise and prove tabular data with Spark DataFrames."""
