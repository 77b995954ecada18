"""Registry of checked queries over the generated test tables."""
