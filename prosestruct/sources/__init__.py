"""Where documents and parses come from, and where results go."""
