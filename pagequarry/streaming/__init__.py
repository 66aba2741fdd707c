"""Crawl frontiers: level by level in batch, or fed back through a folder of URLs."""
