"""glyphlake: a Spark-native engine that audits the text layer of document collections."""
