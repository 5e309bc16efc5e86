"""Column-level building blocks: everything here maps columns to columns and stays inside the JVM."""
