"""Column -> Column helpers built only from JVM-side Spark SQL functions."""

from sparkweave.functions.masks import MASKS, apply_mask, first2, last4, mask_names
from sparkweave.functions.text import clean_newlines, contains_term, long_words_joined
from sparkweave.functions.json import JSON_OPTIONS, decode_json, encode_json

__all__ = [
    "MASKS", "apply_mask", "first2", "last4", "mask_names",
    "clean_newlines", "contains_term", "long_words_joined",
    "JSON_OPTIONS", "decode_json", "encode_json",
]
