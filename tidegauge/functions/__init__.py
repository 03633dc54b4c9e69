"""Column expressions and fixed code tables. Everything here stays inside Catalyst."""
