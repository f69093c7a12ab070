"""weftlens: recorded web traffic, analysed with Spark DataFrames."""
