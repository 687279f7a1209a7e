"""Column-level building blocks: everything here is a built-in Spark expression."""
