"""Pages from files, tables, URLs, sitemaps and robots files."""
