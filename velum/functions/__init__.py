"""Column builders: text, spans and the candidate filter. All are built-in functions of Spark."""
