"""Plans: the catalog of collections, and the statement language."""
