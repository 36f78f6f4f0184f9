"""Column -> Column expressions. All built-in Spark functions (JVM side)."""
