"""Training-data pipeline operators (self-contained subpackage: nothing else in the library imports it)."""
