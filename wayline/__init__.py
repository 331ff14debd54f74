"""Spark-native analytics over agent traces, labelled trace datasets and text corpora."""
