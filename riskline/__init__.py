"""riskline: text-risk classification as Spark DataFrame / Structured Streaming jobs.

Modules:
  functions  - Column -> Column expressions (text cleaning, labels, risk bands)
  sources    - mail CSV ingest, page-text extraction, sinks, vector cache
  operators  - TF-IDF features, pooling, splits, ranking, logistic regression, metrics
  plans      - registry of named queries and their DuckDB oracle SQL
  streaming  - micro-batch scoring, frame sampling, alerts, latest state
"""

__version__ = "0.1.0"
