"""Character classes that mean the same in Spark (Java) and other engines: what counts as blank, word and punctuation."""

#: Blank characters, newline included; fixed values.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
#: Blank characters without the newline.
WS_LINE = r"[\x09\x0b-\x0d\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: Words with inner apostrophes and hyphens.
WORD_PATTERN = WORD + r"+[\p{L}\p{N}_'-]*" + WORD + "+|" + WORD
#: Punctuation peeled off the ends of a token; fixed values.
PUNCT_LEAD = r"""[(\[«"']"""
PUNCT_TRAIL = r"""[.,;:!?)»"']"""
#: Characters that may follow an occurrence of a name; fixed values.
AFTER = r"[ ,;:!?).\]}\p{P}]"
