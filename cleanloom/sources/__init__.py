"""Reading raw tables, and writing cleaned ones."""
