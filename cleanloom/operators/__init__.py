"""Actions on columns, profiles of tables and what is derived from them."""
