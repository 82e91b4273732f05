"""Column expressions; each takes and returns columns and stays in the JVM."""
