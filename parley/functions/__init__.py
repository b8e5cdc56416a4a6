"""Column helpers. Every helper is a native expression, so it stays inside whole-stage codegen."""
