"""Row-level functions: text, hashes and the tables a statement touches."""
