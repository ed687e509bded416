"""Readers, raw landing with committed manifests, contracts and versioned tables."""
