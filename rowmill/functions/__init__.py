"""Column expressions: cleaning, typed conversion and identifier rules."""
