"""Querying and transforming HTML and XML at scale, as DataFrame operations."""
