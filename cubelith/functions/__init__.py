"""Cell functions as Column expressions; missing data is NULL."""
