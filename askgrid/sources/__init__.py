"""Reading and writing sample sets, templates, results and record tables."""
