"""placelore: review analytics, place knowledge tables and trip planning on Spark DataFrames."""
