"""Column expressions and Arrow functions over single texts."""
