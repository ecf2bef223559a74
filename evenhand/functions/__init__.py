"""Column-level building blocks; every function returns built-in Column expressions."""
