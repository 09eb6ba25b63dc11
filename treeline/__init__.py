"""Tree and graph queries over Spark DataFrames."""
