"""Column functions: every one takes Columns and returns a Column, so Catalyst sees plain expressions."""
