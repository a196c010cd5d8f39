"""Turn crawled API documentation into endpoint, spec and quality tables with Spark."""
