"""Operators that prepare training text: near copies, repeats, tokens, packing, archives, pages, vectors."""
