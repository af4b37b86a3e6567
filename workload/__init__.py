"""The library's queries on the given tables, with the SQL to check them."""
