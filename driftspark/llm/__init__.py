"""Training-data operators: tokenizing, search, de-duplication, filtering, anonymizing.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
