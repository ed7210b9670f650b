"""Analytics over spatial-audio and navigation tables, and training-data operators, on Spark DataFrames."""
