"""Column functions: time series of a symbol, cross-sections of a date, scalars, exponential averages."""
