"""Training-data operators: quality, toxicity, duplicates, secrets, packing and their kin.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the registered ``opN_<name>`` queries.
"""
