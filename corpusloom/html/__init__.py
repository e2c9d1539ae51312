"""Pages as trees, inside tasks: each page is parsed once, whatever is asked of it."""
