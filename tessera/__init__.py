"""Evidence retrieval analytics over DataFrames."""
