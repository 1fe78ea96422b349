"""Training-data operators: ten stages of a text corpus pipeline as Spark jobs.

Nothing outside this package imports it; its queries are in :mod:`lattica.llm.queries`.
"""
