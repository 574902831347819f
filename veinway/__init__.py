"""veinway: a Spark-native engine for networks traced from imagery.

Sub-packages: ``functions`` (column expressions), ``operators`` (relations in,
relations out), ``sources`` (readers and writers), ``plans`` (named queries and
their SQL twins) and ``streaming`` (incremental ingestion).
"""

__version__ = "0.1.0"
