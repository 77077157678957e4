"""Market-data analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""
