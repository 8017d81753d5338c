"""Training-data operators. Nothing outside this subpackage imports it, but for the guarded entry file."""
