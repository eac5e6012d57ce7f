"""Sources: files, strings, stored results, repositories and commits."""
