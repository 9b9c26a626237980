"""Readers of stored crawls, logs, sitemaps and lists, and the writers of results."""
