"""Code-security analytics as Spark jobs over tables of source files."""
