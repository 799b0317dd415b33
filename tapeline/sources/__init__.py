"""Table views, readers and store writers."""
