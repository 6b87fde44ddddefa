"""Vocabulary files and exact, fast pre-token splitting for their tokenizers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _classes() -> tuple[str, str, str]:
    """White space, letters and numbers below U+0250 and in U+2000..U+206F, spelt out.

    These blocks have been stable for decades, so any library's tables agree on them.
    """
    space, letters, numbers = "", "", ""
    for cp in [*range(0x250), *range(0x2000, 0x2070)]:
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if cp in (9, 10, 11, 12, 13, 0x85) or kind == "Z":
            space += re.escape(c)
        elif kind == "L":
            letters += re.escape(c)
        elif kind == "N":
            numbers += re.escape(c)
    return space, letters, numbers


SPACE, LETTER, NUMBER = _classes()
#: A character for which the tables above say nothing.
EXOTIC = re.compile("[^\x00-ɏ -⁯]")
#: The byte-level split, with the commonest alternatives first where order is free.
BYTE_LEVEL = re.compile(f" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BYTE_LEVEL_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: The word split of the lower-cased vocabulary; contractions split off a word's start too.
WORD_LEVEL = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
WORD_LEVEL_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: A character that needs the library: beyond the tables, white space of a rarer kind,
#: or changed in length by lower-casing.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e]")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_ALPHABET = _byte_alphabet()
