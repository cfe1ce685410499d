"""Text operators for preparing training corpora, and the queries that apply them."""
