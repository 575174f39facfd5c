"""Readers, writers and the attribute catalog."""
