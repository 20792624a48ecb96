"""operators of paperloom."""
