"""loomframe: a knowledge-retrieval and curation engine written as Spark plans.

Every operator is a function from DataFrames to a DataFrame.  The package is
split by concern: ``sources`` (parsing files into tables), ``functions``
(scalar column expressions), ``operators`` (joins, ranking, graph, retrieval,
lifecycle, quality), ``streaming`` (the change feed), ``plans`` (registered
queries with their SQL twins) and ``llm`` (training-data operators; nothing
else imports it).
"""

__version__ = "0.1.0"
