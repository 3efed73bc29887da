"""loomtext: text and catalogue analytics on Spark DataFrames."""
