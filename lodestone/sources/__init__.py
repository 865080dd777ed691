"""Readers of archives, images, manifests and resource tables."""
