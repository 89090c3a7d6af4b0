"""Landed feed payloads mapped to the canonical listing."""
