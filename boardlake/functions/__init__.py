"""Column functions: every one takes and returns Columns and stays inside Catalyst,
except ``html.clean_html`` and ``html.cards``, which parse HTML in Arrow batches."""
