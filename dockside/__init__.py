"""Order-delivery analytics as plain PySpark DataFrame functions."""
