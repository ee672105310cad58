"""Operators from DataFrame to DataFrame: features, alphas, labels, joins, folds, models, metrics, statistics, simulation."""
