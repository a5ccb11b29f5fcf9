"""Part of starloom."""
