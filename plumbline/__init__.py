"""Documentation-coherence analytics on Spark DataFrames."""
