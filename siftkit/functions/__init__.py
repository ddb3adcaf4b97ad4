"""Column builders: JVM-side expressions that work inside one row."""
