"""Splitting texts into pre-tokens: the tokenizers' pattern with its Unicode classes spelt out as ranges."""

from __future__ import annotations

import re
from functools import lru_cache

import regex

#: Splits text before the merges, put together from its classes of letters, numbers and white space: the pattern of the public rank files, and what a tokenizer file
#: means by a pre-tokenizer ByteLevel with use_regex, which does not spell it out.
SHAPE = r"'(?:s|t|re|ve|m|ll|d)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_BMP = 0x10000


def _ranges(name: str) -> str:
    """The characters of a Unicode class below U+10000 as ranges of a character class."""
    known, found, begin = regex.compile(name), [], None
    for code in range(_BMP + 1):
        inside = code < _BMP and not 0xD800 <= code < 0xE000 and known.match(chr(code)) is not None
        if inside and begin is None:
            begin = code
        elif not inside and begin is not None:
            found.append(f"\\u{begin:04x}-\\u{code - 1:04x}")
            begin = None
    return "".join(found)


class Splitter:
    """The pre-tokens of a text.

    Texts without characters beyond U+FFFF go through the ranges, three times as fast as by Unicode properties; others through the properties.
    """

    def __init__(self):
        self.fast = re.compile(SHAPE.format(L=_ranges(r"\p{L}"), N=_ranges(r"\p{N}"), S=_ranges(r"\s")))
        self.any = regex.compile(SHAPE.format(L=r"\p{L}", N=r"\p{N}", S=r"\s"))

    def of(self, text: str):
        """The compiled pattern for `text`."""
        return self.fast if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.any

    def findall(self, text: str) -> list[str]:
        return self.of(text).findall(text)


@lru_cache(maxsize=1)
def splitter() -> Splitter:
    return Splitter()
