"""Comparable company names: accents, punctuation and legal forms removed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.schemas import LEGAL_FORMS

#: Upper-case letters with marks, and what they become.
MARKED, PLAIN = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ", "AAAAAAEEEEIIIIOOOOOUUUUNCY"
FORMS = r"\b(" + "|".join(LEGAL_FORMS) + r")\b"
#: Forms stacked on each other are removed in as many passes.
PASSES = 6


def without_forms(c: Column) -> Column:
    """Spaces single, legal forms gone."""
    for _ in range(PASSES):
        c = F.trim(F.regexp_replace(F.regexp_replace(c, FORMS, " "), r"\s+", " "))
    return c


def normalised_name(c: str | Column) -> Column:
    """Upper case without accents, marks and legal forms; single letters are still apart."""
    c = F.col(c) if isinstance(c, str) else c
    flat = F.translate(F.upper(F.coalesce(c, F.lit(""))), MARKED, PLAIN)
    # letters written with combining marks
    flat = F.regexp_replace(flat, r"\p{M}+", "")
    return without_forms(F.trim(F.regexp_replace(F.regexp_replace(flat, "[^A-Z0-9]+", " "), r"\s+", " ")))


def initials_joined(name: str) -> str:
    """Runs of single letters as one word, and legal forms that this makes removed."""


    out: list[str] = []
    run = ""
    for word in [*name.split(" "), ""]:
        if len(word) == 1 and "A" <= word <= "Z":
            run += word
            continue
        if run:
            out.append(run)
            run = ""
        if word:
            out.append(word)
    text, before = " ".join(out), None
    while text != before:
        before, text = text, re.sub(r"\s+", " ", re.sub(FORMS, " ", text)).strip()
    return text
