"""Website-corpus audit operators on Spark: links, rules, listings, budgets and reports as DataFrame functions."""
