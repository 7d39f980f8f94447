"""HTTP APIs as tables: request binding, pagination, extraction, computed columns."""
