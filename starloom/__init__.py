"""starloom: a DataFrame-first analytics engine for star catalogues."""

__version__ = "0.1.0"
