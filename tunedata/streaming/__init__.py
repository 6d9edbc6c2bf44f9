"""Incremental (file-stream) execution of the row-wise operators."""
