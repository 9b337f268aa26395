"""Sinks: reports, verdicts, worksheets, EPUB."""
