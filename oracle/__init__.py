"""DuckDB statements that say independently what each registered query must return."""

from oracle.statements import statements

__all__ = ["statements"]
