"""Sources: files, register descriptions, page spans, catalogs, manifests."""
