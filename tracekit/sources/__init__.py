"""Sources and sinks of catalogs, manifests and results."""
