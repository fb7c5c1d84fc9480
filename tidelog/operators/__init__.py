"""Relational operators over change logs, segments and manifests."""
