"""skarn: an SQL engine and data-processing library on PySpark."""
