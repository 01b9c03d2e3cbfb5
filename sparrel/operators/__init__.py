"""Plan compilation, statistics and the I/O cost model."""
