"""Column functions: each takes and returns Columns and stays JVM-side."""
