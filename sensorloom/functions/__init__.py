"""Column expressions: value typing, ids, rule tables, flags."""
