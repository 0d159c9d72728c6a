"""DataFrame operators: k-mers, sketches, Bloom filters, membership, containment."""
