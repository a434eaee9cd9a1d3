"""DataFrame -> DataFrame operators: hierarchy, reading, classification, routing, statistics."""
