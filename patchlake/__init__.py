"""patchlake: patch-memory analytics and corpus operators on Spark DataFrames."""
