"""Assembly-structure analytics on Spark DataFrames."""
