"""Table operators: ``DataFrame -> DataFrame`` functions built on Spark expressions."""
