"""Motion and location activity analytics as Spark DataFrame plans."""
