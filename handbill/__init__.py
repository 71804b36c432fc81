"""handbill: dated listings as Spark DataFrames, from raw documents to published feeds."""
