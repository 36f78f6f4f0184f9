"""opinio: product-review analytics on Spark DataFrames.

Subpackages
-----------
sources    readers: driver tables, review fixture, config CSV, review CSV, stored pages; sinks
functions  Column -> Column expressions (parsing, text features, cleaning, classifier)
operators  DataFrame -> DataFrame operators (cleaning, profiling, sentiment, n-grams,
           aggregates, topic models, exact quantiles)
plans      end-to-end plans and the registered query catalogue
streaming  incremental ingestion of new review files
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]
