"""Document analytics as DataFrame plans."""
