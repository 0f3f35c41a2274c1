"""Named queries over the retail tables, and the SQL they are checked against."""
