"""Column expressions: every function takes and returns Columns and runs inside the JVM."""
