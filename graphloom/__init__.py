"""graphloom: graph analytics over edge and vertex DataFrames, expressed in Spark's relational operators."""
