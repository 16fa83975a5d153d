"""Event-time windows and keyed state, on streams and on tables."""
