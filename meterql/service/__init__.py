"""The HTTP service: statements are priced, charged and only then run."""
