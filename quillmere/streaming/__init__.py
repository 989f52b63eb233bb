"""State machines and streams."""
