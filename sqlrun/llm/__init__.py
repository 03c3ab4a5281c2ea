"""Training-data operators: dedup, joins, scans, quality, counting, search,
tokenization, binary output, language ID and mixing.

Each module holds one operator with a general interface; ``queries`` holds the
registered ``opN_<name>`` queries, thin digests of what the operators return.
Nothing else in the library imports this subpackage.
"""
