"""Readers and writers: parsed documents, fact files, manifests, contracts."""
