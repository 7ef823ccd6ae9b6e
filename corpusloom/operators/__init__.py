"""DataFrame operators: alignment, filters, mixing, encoding, packing, statistics, evaluation."""
