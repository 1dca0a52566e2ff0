"""Spark-native analytics for timed transcripts and dialogues."""
