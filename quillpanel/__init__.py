"""Panel analytics on Spark DataFrames: features, alphas, folds, simulation, statistics."""
