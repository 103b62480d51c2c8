"""Character classes shared by the pure kernels and the Column functions."""

from __future__ import annotations

import re
import sys
from functools import cache

SB = "\ue000"  # the section-break sentinel within texts
SHIELD = "\ue001"  # stands in for an ellipsis while a text is normalized

# The blocks of Han characters, as (first, last).
HAN_BLOCKS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F))
# Punctuation by its role.
END = "。！？?!…"
MID = "、，,;；:："
CLOSE = "」』）】］〉》”’\"'"
CONTINUES = "、，,;；:：—―─━…⋯"

HAN = "".join(f"{chr(a)}-{chr(b)}" for a, b in HAN_BLOCKS)
CHINESE = HAN + "々"
#: The same class for Java's regular expressions.
JAVA_HAN = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in HAN_BLOCKS)
JAVA_CHINESE = JAVA_HAN + "\\x{3005}"

IS_CHINESE = re.compile(f"[{CHINESE}]")
IS_HAN = re.compile(f"[{HAN}]")


@cache
def content() -> re.Pattern[str]:
    """What a span must hold to count: a Chinese character, a digit of any kind, or an ASCII letter."""
    digits = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isdigit())
    return re.compile(f"[{CHINESE}0-9A-Za-z{re.escape(digits)}]")


def is_chinese(c: str) -> bool:
    return bool(c) and IS_CHINESE.match(c) is not None
