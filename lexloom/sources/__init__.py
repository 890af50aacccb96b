"""Readers: files and blobs to rows."""
