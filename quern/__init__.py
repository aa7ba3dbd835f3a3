"""quern: a PySpark-native engine for source-grounded corpora and retrieval evaluation."""
