"""Table contracts, readers and the report writer."""
