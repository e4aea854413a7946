"""Streams of reports and findings."""
