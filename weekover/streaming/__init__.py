"""Incremental refresh of stored reports from a stream of orders."""
