"""Streaming extensions: the same status rules on live readings."""
