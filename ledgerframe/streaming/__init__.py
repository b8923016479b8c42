"""Event-time operators; each works on a stream and on a table."""
