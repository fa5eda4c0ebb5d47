"""Pieces of DuckDB SQL that several oracles share."""

#: A-Z to lower case, other characters as they are.
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of a text: runs without space and the characters 9 to 13.
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def lower_words(column: str) -> str:
    return WORDS.format(ASCII_LOWER.format(f"coalesce({column}, '')"))


def shingle_list(words: str, width: int = 5) -> str:
    """List of all shingles of a word list; fewer words are one, no words none."""
    return (f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {width} THEN [array_to_string({words}, ' ')] ELSE "
            f"list_transform(range(1, len({words}) - {width} + 2), lambda i: array_to_string(list_slice({words}, i, i + {width - 1}), ' ')) END")
