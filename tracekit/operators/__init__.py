"""DataFrame operators: keys, sampling, splits, joins, metrics, profiles."""
