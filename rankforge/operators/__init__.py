"""DataFrame -> DataFrame operators: statistics, imputation and sweep, career
features, taxonomy, privacy, features, labels and groups, ranking, metrics,
learning to rank, vectors, explanations."""
