"""twinseek: Spark-native two-sided retrieval, ranking evaluation and corpus preparation."""
