"""DataFrame operators: classify, parse, normalize, validate, deduplicate, widen."""
