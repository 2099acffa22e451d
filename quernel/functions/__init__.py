"""Column functions: text, keys and numbers. All run on the JVM."""
