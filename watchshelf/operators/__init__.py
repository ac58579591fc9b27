"""Building blocks: filters, paging, lookups, aggregates, merges."""
