"""Training-data operators. Nothing outside this subpackage imports it; ``queries`` holds the registry."""
