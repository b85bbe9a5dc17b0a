"""Object storage, listings, catalog snapshots and reports."""
