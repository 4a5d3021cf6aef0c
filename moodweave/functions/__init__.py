"""Fixed value domains and Column-to-Column functions."""
