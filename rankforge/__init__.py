"""rankforge: a Spark-native engine that ranks pools of semi-structured
profiles against a target description.

Every stage is a DataFrame -> DataFrame function: ingestion of nested
JSON into typed columns, imputation and sweeping, career features, phrase
taxonomy folding, privacy projection, feature scaling, cosine scoring,
weak labels, a pairwise learning-to-rank loop on Spark ML trees, ranking,
NDCG evaluation and plain-language reasons.
"""

__version__ = "0.1.0"
