"""Catalogue matching on Spark: free-text line items against a product catalogue."""
