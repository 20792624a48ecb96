"""plans of paperloom."""
