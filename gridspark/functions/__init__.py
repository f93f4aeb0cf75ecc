"""Column expressions: IEEE arithmetic, physics formulas, scalar helpers and chunk arithmetic."""
