"""Column expressions: text, addresses, money, dates, status, arrays."""
