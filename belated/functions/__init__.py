"""Column expressions over attention curves (arrays of counts by age)."""
