"""Spark-native analytics over grouped study data: sources, operators, functions, plans."""
