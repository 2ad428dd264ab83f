"""Structured Streaming: profiles that land in a folder are summarised as they come."""
