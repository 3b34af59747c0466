"""Column helpers, all evaluated inside the JVM."""
