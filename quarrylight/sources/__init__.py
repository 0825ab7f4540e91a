"""Where repositories come from."""
