"""Column-level helpers: text, URLs, lexicons, ranks and fixed vocabularies."""
