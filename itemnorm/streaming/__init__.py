"""Streams: learned mappings on new items, and appending finished rows exactly once."""
