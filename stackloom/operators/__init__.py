"""DataFrame operators over profile events."""
