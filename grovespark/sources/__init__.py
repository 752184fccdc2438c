"""Readers and writers: file trees, scan files, generated inventories."""
