"""DataFrame operators: pure functions from lazy DataFrames to lazy DataFrames."""
