"""Graph, retrieval and text operators over DataFrames."""
