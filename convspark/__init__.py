"""PySpark-native operators for annotated conversations and text corpora."""
