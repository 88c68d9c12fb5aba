"""Named queries: each operator over the driver's tables, beside the SQL that says the same."""
