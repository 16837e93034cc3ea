"""Parsers of texts that hold records: JSON, CSV, XML, feeds, sitemaps and pages, as columns over a DataFrame of payloads."""
