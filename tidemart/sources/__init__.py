"""Topic sources, record decoding and stored-table readers."""
