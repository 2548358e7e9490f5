"""Order and tick event analytics on PySpark: batch and streaming from one set of operators."""
