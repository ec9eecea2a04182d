"""DataFrame operators of outcome analytics."""
