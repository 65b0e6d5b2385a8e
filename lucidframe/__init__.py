"""Dataset cleaning, profiling and insights as Spark DataFrame transformations."""
