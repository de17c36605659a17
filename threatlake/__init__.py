"""Spark-native threat hunting and large-scale table analytics."""
