"""Column functions: text, JSON, segment formats and extracted-field arrays."""
