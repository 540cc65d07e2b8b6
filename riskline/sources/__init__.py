"""Sources and sinks: driver tables, mail CSV ingest, text extraction, caches, writers."""
