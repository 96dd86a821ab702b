"""plumbline: a Spark-native engine that audits whether a fixed measurement stays valid while its data drift."""
