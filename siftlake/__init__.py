"""siftlake: text condensation over DataFrames of blocks."""
