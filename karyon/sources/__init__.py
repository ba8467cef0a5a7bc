"""Readers and writers: BEDPE, BAM, headers, bins."""
