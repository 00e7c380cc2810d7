"""wobble: stability of dimensionality reductions, on PySpark."""
