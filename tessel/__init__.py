"""Tessel: Spark-native analytics over ordered frame sequences and the question-answering runs made on them."""
