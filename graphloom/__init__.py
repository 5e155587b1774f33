"""graphloom: knowledge-graph analytics as plain PySpark DataFrames."""
