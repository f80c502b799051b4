"""Learning-content analytics on Spark: documents, similarity, graphs, review state."""
