"""Readers and writers of binary log, segment and manifest files."""
