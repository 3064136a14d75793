"""treemill: Spark-native scoring, auditing and retrieval over annotated sentences.

Sub-packages: ``sources`` (readers), ``operators`` (DataFrame to DataFrame),
``functions`` (column expressions), ``plans`` (registered queries and their SQL
twins), ``streaming`` (incremental ingestion).  ``llm`` holds the operators for
training data; nothing outside it imports it.
"""
