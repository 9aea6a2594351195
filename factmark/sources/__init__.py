"""Readers that turn files into facts, and the versioned fact table they feed."""
