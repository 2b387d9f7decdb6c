"""The order of equal ids: Spark's hash of the text."""

import xxhash


def order_of(text):
    if text is None:
        return 42
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h
