"""Writers: files, catalog tables, versioned path tables."""
