"""Fleet-scale time-series investigation on PySpark."""
