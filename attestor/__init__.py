"""attestor: an evidence-analytics engine expressed as Spark DataFrames."""
