"""Training-data operators over documents, conversations, pages and embeddings.

Each module holds one operator with a general interface; ``catalog`` holds the
thin registered queries (``opN_<name>``). Nothing else in the library imports
this subpackage.
"""
