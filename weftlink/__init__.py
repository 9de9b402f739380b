"""Spark-first analytics over crawled pages: link opportunities between the pages of a site."""
