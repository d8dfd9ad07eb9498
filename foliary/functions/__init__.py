"""foliary subpackage."""
