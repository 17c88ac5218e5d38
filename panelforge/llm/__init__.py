"""Training-data operators: filtering, deduplication, tokenisation and chat rendering on Spark.

Each module holds one operator with its own general interface; ``queries`` holds the thin digest
queries over the synthetic tables. Nothing outside this subpackage imports it.
"""
