"""Readers and writers for state, listings, inventories, rules and samples."""
