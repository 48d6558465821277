"""Planning: pure arithmetic, no data."""
