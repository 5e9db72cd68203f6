"""quire: build and judge labelled text corpora with Spark DataFrames."""

SEED = 42
