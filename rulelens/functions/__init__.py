"""Column functions: no joins, no shuffles, all evaluated in the JVM."""
