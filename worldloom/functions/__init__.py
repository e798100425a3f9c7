"""Column expressions and the pure Python functions behind the few Arrow UDFs."""
