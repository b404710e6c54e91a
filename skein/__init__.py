"""skein: retrieval, ranking and token-budget packing on DataFrames."""
