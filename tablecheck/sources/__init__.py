"""Reading tables and catalogs, and publishing new table versions."""
