"""Training-data operators: corpus operators as Spark jobs, and their registered queries.

Nothing else in the library imports this subpackage; ``queries.py`` registers one query per
operator and ``corpus_pipeline.py`` (repository top) chains five of them.
"""
