"""Retrieval operators: chunking, keyword and vector ranking, fusion, index maintenance, converters."""
