"""Column helpers: dates, tokens, codecs."""
