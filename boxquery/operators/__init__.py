"""DataFrame operators: ordering, blocks, tiles, clustering, reports, changes."""
