"""DataFrame operators: last-write-wins merge, reads, conditional upsert, statistics."""
