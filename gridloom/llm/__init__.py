"""Training-data operators: licences, fixity, deduplication, PII, media, HTML, mixing, language, leaks."""
