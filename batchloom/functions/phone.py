"""Does a contact text hold a phone number?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from batchloom.functions.scalars import strip

# --- fixed values ---------------------------------------------------------------
# Number shapes, tried in this order; only the first hit of each counts.
SHAPES = [
    r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,4}",
    r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    r"\b0\d{9,10}\b",
    r"\b\d{2,4}[-.\s]\d{2,4}[-.\s]\d{2,4}[-.\s]\d{2,4}(?:[-.\s]\d{2,4})?\b",
    r"\b\d{10}\b",
    r"\b\d{11}\b",
]
# Words that announce a number.
PHONE_WORDS = [
    "phone", "tel", "telephone", "call", "contact", "number", "mobile", "cell",
    "ph", "tél", "téléphone", "fono", "telefono", "手", "机", "电", "话",
    "contacto", "numero", "celular", "móvil",
]
# Words that rule a text out, also inside other words.
OTHER_WORDS = [
    "invoice", "account", "id", "order", "reference", "tracking", "serial",
    "receipt", "transaction", "policy", "claim", "ticket", "booking",
    "reservation", "confirmation", "code", "pin", "password", "license",
]
# Numbers nobody owns.
TEST_NUMBERS_10 = [
    "1111111111", "2222222222", "3333333333", "4444444444", "5555555555", "6666666666",
    "7777777777", "8888888888", "9999999999", "0000000000", "0123456789", "9876543210",
]
TEST_NUMBERS_11 = ["12345678901", "09876543210", "11111111111"]
# --------------------------------------------------------------------------------

ANNOUNCED = "(?:" + "|".join(PHONE_WORDS) + r")[:\s]*([^\s,]+)"
DIALLABLE = r"^[\d\s\(\)\-\.\+]{7,}$"
SEPARATORS = r"[() .+\-]"
UNICODE = "(?U)"


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, UNICODE + r"\D", ""))


def _verdict(candidate: Column, mode: str) -> Column:
    """True or false when the candidate settles the matter, else null."""
    bare = ~candidate.rlike(SEPARATORS)
    out = F.when(bare & (_digits(candidate) == 10), ~candidate.isin(TEST_NUMBERS_10))
    if mode == "intended":
        out = out.when(bare & (_digits(candidate) == 11), ~candidate.isin(TEST_NUMBERS_11))
        out = out.when(_digits(candidate).between(7, 15), F.lit(True))
    return out


def phone_flag(contact: Column, mode: str = "executed") -> Column:
    """Phone flag of a contact text.

    ``executed``: among the shapes only a bare ten-digit number settles the
    matter; otherwise the text after the first announcing word decides.
    ``intended`` also lets eleven digits and formatted numbers settle it.
    """
    if mode not in ("executed", "intended"):
        raise ValueError(f"unknown mode {mode!r}")
    lowered = F.lower(contact)
    absent = F.coalesce(contact, F.lit("")).isin("") | (F.upper(strip(contact)) == "N/A")
    ruled_out = reduce(lambda a, b: a | b, [lowered.contains(w) for w in OTHER_WORDS])
    # an empty candidate has no digits and so settles nothing
    shapes = SHAPES if mode == "intended" else SHAPES[1:5]
    verdicts = [_verdict(F.regexp_extract(contact, UNICODE + s, 0), mode) for s in shapes]
    said = F.regexp_extract(lowered, UNICODE + ANNOUNCED, 1)
    announced = said.rlike(UNICODE + DIALLABLE) & _digits(said).between(7, 15)
    # every way to a number needs seven digits, so most texts end here
    few = _digits(contact) < 7
    return F.when(absent | few | ruled_out, F.lit(False)).otherwise(F.coalesce(*verdicts, announced, F.lit(False)))
