"""Analytics over a revisioned knowledge graph, and training-data operators, as PySpark jobs."""
