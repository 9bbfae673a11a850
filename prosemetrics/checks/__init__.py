"""Declared checks: what each looks at, what it finds and how it counts."""
