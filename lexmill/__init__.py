"""lexmill: document-corpus analytics declared as Spark DataFrames."""
