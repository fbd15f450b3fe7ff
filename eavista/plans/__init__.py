"""The six reports."""
