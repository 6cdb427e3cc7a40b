"""Spark-native long-read transcriptome annotation."""
