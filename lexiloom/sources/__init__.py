"""Readers and writers: file listings, page tables, JSON columns, reports and manifests."""
