"""DataFrame operators; each one returns a lazy DataFrame."""
