"""Source code analysed as data, on Spark."""
