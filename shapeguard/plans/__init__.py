"""From checked questions to column expressions."""
