"""Streams of dated images."""
