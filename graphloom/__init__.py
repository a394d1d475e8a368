"""graphloom: a property-graph query engine whose plans are Spark DataFrames."""
