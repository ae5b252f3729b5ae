"""lodestream: pattern-mining and training-data operators as Spark DataFrame plans."""
