"""Training-data operators (deduplication, tokenisation, packing, screening, formatting).

Nothing outside this folder imports it; ``registry`` holds its queries and SQL.
"""
