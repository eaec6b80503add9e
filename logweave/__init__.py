"""logweave - Spark-native log mining, anomaly ranking and passage retrieval.

Every public operator is a function ``DataFrame(s) -> DataFrame``: it builds a
lazy logical plan and never collects data to the driver.
"""

__version__ = "0.1.0"
