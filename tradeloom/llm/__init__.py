"""Training-data operators: counting, scoring, filtering, joining and packing documents.

Functions that run in Python workers are imported there by name, so that loaded
vocabularies and models stay in the worker; ``common.in_tasks`` sends them the package.
"""
