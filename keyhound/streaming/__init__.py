"""The same scan over streams."""
