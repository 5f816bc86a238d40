"""Column expressions. Everything here stays on the JVM side."""
