"""Files: what they look like, reading them, and writing files that look the same."""
