"""DataFrame operators: keys, aggregation, strategies, records, profiles, statistics."""
