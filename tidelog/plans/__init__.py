"""The store: operators put together over a folder of tables."""
