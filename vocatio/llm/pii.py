"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, address schemes and
identifier cues.  From each anchor a local parser expands to the maximal run that a value of its
kind can have, and validates it there.  A run is parsed once, however many anchors it holds, so the
work is linear in the text.

Kinds, in the order that breaks ties between spans with one start: email, ip, card and phone (the
base kinds), then ``address`` (a scheme followed by user information and a host) and ``account``
(an identifier right after a cue word such as IBAN or passport).  A cue stands alone, and its kind
says how the identifier is written and checked: IBANs by their check digits and length, social
security numbers by their three groups, passports, tax and account numbers by their digits.  What
follows must end there; words, years and dates are no identifiers.

Null text counts as empty: no spans.  Offsets are code points, ends exclusive.  Rows are handled
one by one, so repeated and null ids each keep their row.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
SPANS = "array<struct<kind:string,start:long,end:long>>"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9. -]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z]")
_AUTHORITY = re.compile(r"[^\s/?#@:]+(?::[^\s/?#@]*)?@[A-Za-z0-9.-]*[A-Za-z0-9]")
_LEAD = re.compile(r"(?: (?:no|nr|number|num|id)\b\.?)?(?: ?[:#=]){0,2} ?(?:is )?", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PASSPORT = re.compile(r"[A-Z]{0,2}[0-9]{6,9}(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9])")
_TAX = re.compile(r"(?:[0-9]{2}-[0-9]{7}|[0-9]{9,11})(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:[0-9]{4}(?: [0-9]{4})+(?: [0-9]{1,4})?|[0-9]+(?:-[0-9]+)+|[0-9]{6,20})(?![A-Za-z0-9])")
_DATES = re.compile(r"(?:19|20)[0-9]{2}(?:[ -](?:19|20)[0-9]{2}|-[0-9]{1,2}(?:-[0-9]{1,2})?)|[0-9]{1,2}-[0-9]{1,2}-(?:19|20)?[0-9]{2}")
#: Cue words, and the forms of what may follow them.
CUES = {
    "iban": (_IBAN,),
    "passport": (_PASSPORT,),
    "social security": (_SOCIAL,),
    "ssn": (_SOCIAL,),
    "tax id": (_TAX,),
    "account": (_IBAN, _NUMBER),
    "acct": (_IBAN, _NUMBER),
    "konto": (_IBAN, _NUMBER),
    "compte": (_IBAN, _NUMBER),
    "cuenta": (_IBAN, _NUMBER),
}


@cache
def _anchors():
    from ahocorasick import Automaton

    found = Automaton()
    for digit in "0123456789":
        found.add_word(digit, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title(), cue.title().replace(" Id", " ID"), cue.replace(" id", " ID")}:
            found.add_word(form, cue)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _left(text: str, at: int, stop: int, allowed: re.Pattern) -> int:
    while at > stop and allowed.match(text, at - 1):
        at -= 1
    return at


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def iban(number: str) -> bool:
    """15 to 34 letters and digits whose check digits hold."""
    bare = number.replace(" ", "")
    turned = bare[4:] + bare[:4]
    return 15 <= len(bare) <= 34 and bare.isascii() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The identifier that follows a cue which ends at ``at``."""
    before = text[at - len(cue) - 1 : at - len(cue)]
    if before.isalnum() or text[at : at + 1].isalnum():
        return None
    start = _LEAD.match(text, at).end()
    if start == at:
        return None
    for form in CUES[cue]:
        if not (m := form.match(text, start)):
            continue
        found = m[0]
        if form is _IBAN:
            while " " in found and not iban(found):  # words in capitals may follow
                found = found.rpartition(" ")[0]
            if not iban(found):
                continue
        elif form is _NUMBER and (not 6 <= len(_digits(found)) <= 20 or _DATES.fullmatch(found)):
            continue
        return start, start + len(found)
    return None


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then kind."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    email_end = numeric_end = 0
    for last, anchor in _anchors().iter(text):
        if anchor == "digit":
            if last < numeric_end:
                continue
            numeric_end = _NUMERIC.match(text, last).end()
            if numeric_end - last < 7:
                continue
            for m in _IP.finditer(text, last, numeric_end):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    spans.append((m.start(), m.end(), "ip"))
            for m in _CARD.finditer(text, last, numeric_end):
                number = _digits(m[0])
                if 12 <= len(number) <= 19 and luhn(number):
                    spans.append((m.start(), m.end(), "card"))
        elif anchor == "at":
            start = _left(text, last, email_end, _LOCAL)
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                spans.append((start, email_end, "email"))
        elif anchor == "plus":
            if (m := _PHONE.match(text, last)) and 9 <= len(_digits(m[0])) <= 15:
                spans.append((last, m.end(), "phone"))
        elif anchor == "scheme":
            start = _left(text, last - 2, 0, _SCHEME)
            if start < last - 2 and (m := _AUTHORITY.match(text, last + 1)):
                spans.append((start, m.end(), "address"))
        elif (span := _account(text, last + 1, anchor)) is not None:
            spans.append((*span, "account"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                rows = [
                    [{"kind": k, "start": s, "end": e} for s, e, k in find_spans(text)]
                    for text in piece.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, f"doc_id long, spans {SPANS}")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one, named by the
    first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text masked, and n_chars (if there) counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                text = [t and masked(t, find_spans(t)) for t in piece.column(names.index("text")).to_pylist()]
                columns = list(piece.columns)
                columns[names.index("text")] = pa.array(text, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        same = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        out = out.withColumn("n_chars", same)
    return out.select(*[F.col(f"`{c}`") for c in names])
