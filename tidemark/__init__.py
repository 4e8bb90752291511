"""tidemark: point-in-time analytics over amended filings, as DataFrame operators on Spark."""
