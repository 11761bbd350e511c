"""Pre-tokens of byte-level BPE vocabularies: the pattern's matches."""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

import regex

#: Fixed value: what the public vocabularies' pattern takes for white space, as Unicode has it, which is less than str.isspace().
SPACE = r"\t\n\x0B\x0C\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Texts up to this code point are matched by a pattern that lists their letters and numbers, three times as fast.
LATIN_END = 0x24F


def _pattern(letters: str, numbers: str, space: str) -> str:
    """The public pattern. No two of its parts but the marks' begin alike, so that letters, the most frequent ones, can come first."""
    return rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


def _latin(kind: str) -> str:
    """Ranges of the code points up to LATIN_END that are of a general category."""
    own = (c for c in range(LATIN_END + 1) if unicodedata.category(chr(c)).startswith(kind))
    runs = ([c for _, c in run] for _, run in groupby(enumerate(own), lambda x: x[1] - x[0]))
    return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)


_beyond_latin = re.compile(f"[^\x00-\\u{LATIN_END:04x}]").search
_find_latin = re.compile(_pattern(_latin("L"), _latin("N"), r"\t\n\x0B\x0C\r \x85\xA0")).findall
_find_any = regex.compile(_pattern(r"\p{L}", r"\p{N}", SPACE), regex.V0).findall


def find_pretokens(text: str) -> list[str]:
    return _find_any(text) if _beyond_latin(text) else _find_latin(text)
