"""Column functions; all stay on the JVM side."""
