"""inkfold: sketch and icon retrieval analytics expressed as Spark DataFrames."""
