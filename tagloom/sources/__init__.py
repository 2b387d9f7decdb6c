"""Readers of manifest formats and writers of results. Readers attach (source_file, line_no), which Spark has no order without."""
