"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and words that announce
an identifier. Around each anchor a deterministic parser expands to the boundaries of an email, an address or an
account and validates it. A parser never looks twice at what a span of its kind already covers.

Kinds. Base: email, ip, card, phone. Added: iban (check digits valid), account (identifier after a cue word),
login (credentials before the host of a URL). Cue words and schemes are found in any case (A-Z). Null and empty texts
have no spans, repeated rows and ids each have their own, and a text may be of any length: no number is read from more
than 34 digits. Of docs' other columns find() returns none and mask() all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandwork.llm.shared import as_bytes, steps

#: Kinds in the order in which they are listed at one start.
KINDS = ["email", "ip", "card", "phone", "iban", "account", "login"]
CUES = ["account number", "account no", "acct no", "passport number", "passport no", "ssn", "social security number", "tax id", "customer id"]
SCHEMES = ["http://", "https://", "ftp://"]
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HOST = DIGITS | UPPER | frozenset("abcdefghijklmnopqrstuvwxyz-")
LOCAL = HOST | frozenset("._%+")
DIAL = DIGITS | frozenset(" ().-")
PLAIN = HOST - {"-"}


def _run(text: str, at: int, allowed: frozenset) -> int:
    """Where the run of allowed characters that starts at ``at`` ends."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    """The email around an at-sign whose local part starts at ``floor`` or later."""
    start = sign
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, sign + 1, HOST)
    if start == sign or end == sign + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (to := _run(text, end + 1, HOST)) > end + 1:
        end, labels = to, labels + 1
    return (start, end) if labels else None


def ip(text: str, start: int) -> tuple[int, bool] | None:
    """End of four dotted numbers that start here, and whether all are at most 255."""
    at, fits = start, True
    for part in range(4):
        if part:
            if at >= len(text) or text[at] != ".":
                return None
            at += 1
        end = _run(text, at, DIGITS)
        if end == at:
            return None
        value = text[at:end].lstrip("0")
        fits &= len(value) < 4 and int(value or 0) <= 255
        at = end
    return at, fits


def digits_with_gaps(text: str, start: int) -> int:
    """End of the digits that start here, with at most one space or hyphen between two."""
    at, n = start + 1, len(text)
    while at < n:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    return at


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def phone(text: str, plus: int) -> int | None:
    """End of a phone number after a plus sign, if one stands here (its digits are not counted yet)."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, DIAL)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end - plus >= 4 else None


def iban(text: str, start: int) -> int | None:
    """End of an account number with valid check digits, with or without single spaces."""
    size = IBAN_LENGTH.get(text[start : start + 2])
    if size is None or (start and text[start - 1] in PLAIN):
        return None
    found, at = "", start
    while at < len(text) and len(found) < size:
        if text[at] in DIGITS or text[at] in UPPER:
            found += text[at]
        elif text[at] != " " or text[at - 1] == " ":
            return None
        at += 1
    if len(found) < size or not (set(found[2:4]) <= DIGITS) or (at < len(text) and text[at] in PLAIN):
        return None
    return at if int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1 else None


def account(text: str, cue_end: int) -> tuple[int, int] | None:
    """The identifier after a cue: 6 to 20 letters, digits or hyphens, four digits at least."""
    at = cue_end
    while at < len(text) and at < cue_end + 4 and text[at] in " :#=":
        at += 1
    end = _run(text, at, HOST)
    value = text[at:end].rstrip("-")
    if at == cue_end or not 6 <= len(value) <= 20 or sum(c in DIGITS for c in value) < 4:
        return None
    return at, at + len(value)


def login(text: str, after_scheme: int) -> tuple[int, int] | None:
    """user:password before the at-sign of a URL."""
    end = after_scheme
    while end < len(text) and text[end] not in "/?# \t\r\n\"'<>@":
        end += 1
    if end >= len(text) or text[end] != "@" or ":" not in text[after_scheme + 1 : end]:
        return None
    return after_scheme, end


def _automaton(groups: list[tuple[str, list[str]]]):
    found = ahocorasick.Automaton()
    for kind, words in groups:
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


#: Anchors that are found as they stand, and those that are found in the lower-cased text.
SIGNS = _automaton([("@", ["@"]), ("+", ["+"]), ("d", sorted(DIGITS)), ("i", list(IBAN_LENGTH))])
NAMES = _automaton([("s", SCHEMES), ("c", CUES)])
LOWER = {c: c + 32 for c in range(65, 91)}


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data, by start, then kind as listed."""
    out = []
    past = dict.fromkeys(KINDS, 0)  # where the search for each kind goes on
    last_digit = -2
    for at, (anchor, size) in SIGNS.iter(text):
        if anchor == "d":
            if at >= past["card"]:
                end = digits_with_gaps(text, at)
                if end - at > 1:
                    past["card"] = end
                    if end - at >= 14:
                        number = text[at:end].replace(" ", "").replace("-", "")
                        if 14 <= len(number) <= 19 and luhn(number):
                            out.append((at, end, "card"))
                else:
                    past["card"] = at + 1
            if at >= past["ip"] and (last_digit != at - 1 or at == past["ip"]):  # the first digit of a run
                found = ip(text, at)
                if found:
                    past["ip"] = found[0]
                    if found[1]:
                        out.append((at, found[0], "ip"))
            last_digit = at
        elif anchor == "@":
            found = email(text, at, past["email"])
            if found:
                past["email"] = found[1]
                out.append((*found, "email"))
        elif anchor == "+":
            if at >= past["phone"]:
                end = phone(text, at)
                if end:
                    past["phone"] = end
                    if 10 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                        out.append((at, end, "phone"))
        else:
            start = at - size + 1
            if start >= past["iban"] and start + 2 < len(text) and text[start + 2] in DIGITS:
                end = iban(text, start)
                if end:
                    past["iban"] = end
                    out.append((start, end, "iban"))
    lowered = text.lower() if text.isascii() else text.translate(LOWER)  # of the same length
    for at, (anchor, size) in NAMES.iter(lowered):
        if anchor == "c":
            start = at - size + 1
            if start >= past["account"] and not (start and text[start - 1] in PLAIN):
                found = account(text, at + 1)
                if found:
                    past["account"] = found[1]
                    out.append((*found, "account"))
        else:
            found = login(text, at + 1)
            if found and found[0] >= past["login"]:
                past["login"] = found[1]
                out.append((*found, "login"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of spans replaced by the kind of its first span, as <kind>."""
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as (id, spans array of kind, start, end)."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [spans(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            listed = pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in f] for f in found], pa.list_(item))
            yield pa.record_batch([batch.column("id"), listed], names=["id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text")).mapInArrow(
        run, "id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the spans of each text masked; length_col follows a changed text. Rows without spans stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            found = [spans(t) for t in texts]
            yield pa.record_batch(
                [batch.column("row"), pa.array([masked(t, f) if f else None for t, f in zip(texts, found)], pa.string())], names=["row", "masked"]
            )

    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), as_bytes(text_col).alias("text"))
    done = plain.mapInArrow(run, StructType([plain.schema["row"], StructField("masked", StringType())]))
    new = {text_col: F.col("masked")} | ({length_col: F.char_length("masked").cast(docs.schema[length_col].dataType)} if length_col else {})
    return done.select(*[(F.coalesce(new[c], F.col(f"row.`{c}`")) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
