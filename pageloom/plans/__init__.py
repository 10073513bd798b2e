"""Read-side queries, and the registered queries with their SQL counterparts."""
