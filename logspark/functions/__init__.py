"""Column expressions: everything here runs inside Spark's own code generation."""
