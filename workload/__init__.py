"""The operators run on the driver's tables: stand-in views, queries and their SQL twins."""
