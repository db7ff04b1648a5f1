"""loomgraph: knowledge-graph and reasoning-data analytics on PySpark DataFrames."""
