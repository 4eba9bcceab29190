"""Column-level building blocks: text, URLs, HTML, vectors."""
