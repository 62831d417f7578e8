"""Column expressions: no action, no Python at run time."""
