"""tuneweave: instruction-tuning data preparation and training-log analytics
as Spark DataFrame plans.

Subpackages:

* ``functions`` — Column expressions (fixed values, array padding and masks,
  prompt templates, throughput formulas, rounding);
* ``operators`` — DataFrame operators (order and splits, tokenization, chat
  templates, adapters, packing, batching, scans, training-log metrics,
  rollout analytics);
* ``sources`` / ``sinks`` — JSON and Parquet inputs, token caches, scalar
  series, content-keyed persistence;
* ``streaming`` — stateful training metrics over a streaming step log;
* ``plans`` — end-to-end entry points (``plans.prepare``) and the registered
  queries with their DuckDB oracle SQL (``plans.catalog``).
"""

__version__ = "0.1.0"
