"""Training-data operators: formatting, scanning, dedup, mixing, tokenising, searching.

Nothing else in the library imports this subpackage; delete it (with
``corpus_pipeline.py``) and the rest keeps working.
"""
