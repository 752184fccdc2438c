"""Structured Streaming: rendezvous of two sides, incremental scans."""
