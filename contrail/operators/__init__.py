"""DataFrame operators: ``DataFrame -> DataFrame`` functions with column names as parameters."""
