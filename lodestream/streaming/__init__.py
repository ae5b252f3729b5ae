"""Stream sketches: as relations over numbered elements, and with state over streams."""
