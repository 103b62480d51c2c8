"""Titles that begin as the headings of parts do; the rule of ``functions.predicates`` for the kernels that read pages."""

from __future__ import annotations

import re

from vellum.functions.predicates import DOT, NUMERALS, ROMAN, STRUCTURAL, UNITS

SHORT = re.compile(f"(?:第?[{NUMERALS}]+[{UNITS}]?|[{NUMERALS}]+{DOT}?|[{ROMAN}]+{DOT}?|[IVXLCDM]+{DOT}?)")
HEAD = re.compile(f"(?:第?[{NUMERALS}]+[{UNITS}]|[{NUMERALS}]+(?:[{UNITS}]|{DOT})|[{ROMAN}IVXLCDM]+(?:[{UNITS}]|{DOT}))")
TERMS = frozenset(STRUCTURAL)


def structural(title: str) -> bool:
    """Whether a title is a short label, a term for a part, or begins with one."""
    words, bare = " ".join(title.split()), "".join(title.split())
    if words.lower() in TERMS or bare.lower() in TERMS:
        return True
    label = words != "" and len(words) <= 40 and len(bare) <= 20 and SHORT.fullmatch(bare) is not None
    return label or (0 < len(bare) <= 80 and HEAD.match(bare) is not None)
