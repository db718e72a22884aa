"""Numeric kernels in numpy; none of them knows about Spark."""
