"""Training-data operators (toxicity, deduplication, decontamination, mixing, sharding).

Nothing outside this folder imports it; ``queries.py`` lists its queries for
``__spark_entry__.py``.
"""
