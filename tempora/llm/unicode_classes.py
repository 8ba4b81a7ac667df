"""Character classes for the standard ``re`` module, built from the Unicode database."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

#: The characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.lru_cache(maxsize=None)
def of_category(first_letter: str, top: int = sys.maxunicode) -> str:
    """The inside of a bracket expression for the code points up to ``top`` whose general category starts so."""
    parts, begin = [], None
    for point in range(top + 2):
        inside = point <= top and unicodedata.category(chr(point))[0] == first_letter
        if inside and begin is None:
            begin = point
        elif not inside and begin is not None:
            parts.append(f"\\U{begin:08x}" + (f"-\\U{point - 1:08x}" if point - 1 > begin else ""))
            begin = None
    return "".join(parts)


def white_space() -> str:
    """All characters of ``WHITE_SPACE``."""
    return "".join(re.findall(f"[{WHITE_SPACE}]", "".join(map(chr, range(0x3001)))))
