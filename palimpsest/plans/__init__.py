"""Session plumbing."""
