"""Readers: raw feeds, catalogue pages and serving tables, batch or streaming."""
