"""Readers and writers of filings, panels and report tables."""
