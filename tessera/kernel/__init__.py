"""Pure Python kernels without Spark."""
