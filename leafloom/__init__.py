"""leafloom: drug-safety knowledge-graph and text analytics, expressed as Spark DataFrames."""
