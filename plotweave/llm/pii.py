"""Personal data, also where it is disguised.

Plain identifiers are found in the text as it is. Then transducers rewrite disguises and keep
for each written character the source characters it stands for: look-alike letters, digits of
other scripts and invisible characters; runs of spelled digits; "at", "dot" and "plus" in
brackets or in a context that only an identifier has. The same detectors run on the rewritten
text, and what they find is mapped back to source characters. A span is added if a rewrite
touched it and no plain span holds it already; plain spans always stay, also those that are a
rest of a wider disguised one.

Look-alikes are those listed below (Cyrillic and Greek letters, full-width forms, decimal digits
of any script, mathematical letters); letters of other scripts are left as they are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plotweave.llm.bytekit import CHUNK_BYTES, LOWER, chunks, gather_ranges, utf8

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind (index in KINDS), end

# The base patterns of the contract. Starts that cannot match are not tried, so
# long runs cost linear time: an email is looked for around each "@", and an address only from
# the first digit of a run.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters that look like Latin ones (Cyrillic, then Greek), and their Latin letters.
_ALIKE = dict(zip("аеорсхуіјѕԁԛԝһӏАВЕКМНОРСТХУІЈЅ", "aeopcxyijsdqwhlABEKMHOPCTXYIJS", strict=True))
_ALIKE |= dict(zip("пмктнгиьв", "nmkthrubb", strict=True))
_ALIKE |= dict(zip("αοννρτυικχωεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aovvptuikxweABEZHIKMNOPTYX", strict=True))
_INVISIBLE = frozenset("​‌‍⁠﻿­")
_SPECIAL = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", "․": ".", "。": ".", "﹒": ".", "﹫": "@"}
# Spelled digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ONE = "|".join(_DIGITS)
_SPELLED = re.compile(rf"(?i)\b(?:{_ONE})(?:[\s,-]+(?:{_ONE}))*\b")
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|\s+dot\s+)"
_AT = rf"(?:{_OPEN}(?:at|@){_CLOSE}|\s+at\s+|\s+@\s+)"
_LABEL = r"[A-Za-z0-9-]+"
_PIECE = r"[A-Za-z0-9_%+-]+"
#: An address is looked for around its separator, so that words that are none cost linear time: the domain after it,
#: then, in the reversed text, the pieces before it. White space belongs to a separator from its first character on.
_SEPARATOR = re.compile(rf"(?i)(?<!\s){_AT}|@")
_AFTER = re.compile(rf"(?i){_LABEL}(?:(?:\.|{_DOT}){_LABEL})+")
_BEFORE = re.compile(rf"(?i)(?:\.|\s*[\])}}>]\s*(?:tod|\.)\s*[\[({{<]\s*|\s+tod\s+)?({_PIECE})")
_MAIL_AT = re.compile(rf"(?i){_AT}")
_ANY_DOT = re.compile(rf"(?i){_DOT}")
_DIGIT_DOT = re.compile(rf"(?i)(?<=[0-9]){_DOT}(?=[0-9])")
_PLUS = re.compile(r"(?i)\bplus\s+(?=[0-9])")
#: Where an ASCII text may hold a disguise (on lower-case bytes of one row): all that the transducers need to begin with.
_WHITE = rb"[\s\x1c-\x1f]"
_HINT = re.compile(rb"\b(?:dot|" + _ONE.encode() + rb")\b|[\[({<]" + _WHITE + rb"*(?:at|@|\.)" + _WHITE + rb"*[\])}>]|\bplus" + _WHITE + rb"|" + _WHITE + rb"@" + _WHITE)
_BYTES = np.arange(256)
_PLAIN_HINT = ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES == 64)


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Plain identifiers, leftmost and without overlap in each kind; failing matches are dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewritten:
    """A text and, for each of its characters, the source characters [start, end) it stands for."""

    def __init__(self, source: str):
        self.text = source
        self.changed: np.ndarray | None = None  # until the first edit

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the given ranges, in order and apart from one another."""
        if not edits:
            return
        if self.changed is None:
            n = len(self.text)
            self.start, self.end, self.changed = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32), np.zeros(n, bool)
        text, at = [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            at = b
        text.append(self.text[at:])
        # Each edit is what is kept before it, then its new characters; the last part is the rest.
        begin, stop, size = (np.array(x, np.int64) for x in zip(*((a, b, len(new)) for a, b, new in edits), strict=True))
        here = np.concatenate([[0], stop])
        kept = np.concatenate([begin, [len(self.text)]]) - here
        old = gather_ranges(here, kept)
        fresh = np.cumsum(kept)[:-1].repeat(size)
        place = np.insert(old, fresh, -1)
        new = place < 0
        each = [np.empty(len(place), np.int32) for _ in range(2)]
        for out, held, edge in zip(each, (self.start, self.end), (begin, stop - 1), strict=True):
            out[~new], out[new] = held[old], held[edge].repeat(size)
        changed = np.ones(len(place), bool)
        changed[~new] = self.changed[old]
        self.text, (self.start, self.end), self.changed = "".join(text), each, changed


def _letters(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in re.finditer(r"[^\x00-\x7f]", text):
        c, new = m[0], None
        if c in _INVISIBLE:
            new = ""
        elif c in _SPECIAL:
            new = _SPECIAL[c]
        elif c in _ALIKE:
            new = _ALIKE[c]
        elif "！" <= c <= "～":
            new = chr(ord(c) - 0xFEE0)
        elif (digit := unicodedata.decimal(c, None)) is not None:
            new = str(digit)
        elif ord(c) >= 0x1D400 and len(plain := unicodedata.normalize("NFKC", c)) == 1 and plain.isascii():
            new = plain
        if new is not None:
            edits.append((m.start(), m.end(), new))
    return edits


#: What else a pattern takes for "i" or "s" where case is ignored, as str.lower leaves it.
_CASED = {0x131: "i", 0x307: None, 0x17F: "s"}
#: Lead bytes of all characters beyond ASCII that a transducer rewrites, takes for white space or for a letter.
_SCRIPT_HINT = np.isin(_BYTES, [*{c.encode()[0] for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if _letters(c) or c.isspace() or c in "ıİſ"}, *range(0xF0, 0xF5)])


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits: two or more of them, or one beside a digit, a dot word or a plus."""
    edits = []
    for m in _SPELLED.finditer(text):
        parts = re.split(r"[\s,-]+", m[0])
        near = re.search(r"(?i)(?:[0-9][\s-]?|\bdot\s+|\bplus\s+)$", text[max(0, m.start() - 8) : m.start()]) or re.match(r"(?i)[\s-]?[0-9]|\s+dot\s", text[m.end() : m.end() + 8])
        if len(parts) > 1 or near:
            edits.append((m.start(), m.end(), "".join(_DIGITS[p.lower().translate(_CASED)] for p in parts)))
    return edits


def _addresses(text: str):
    """Ranges of local at label dot label, plain or disguised, from the leftmost piece that may begin one."""
    back, n, done = None, len(text), 0
    at = _SEPARATOR.search(text)
    while at:
        found = _AFTER.match(text, at.end()) if at.start() > done and text[at.start() - 1] in _LOCAL_CHARS else None
        start = None
        if found:
            back = text[::-1] if back is None else back
            k = n - at.start()
            piece = _BEFORE.match(back, k)
            first = True
            while piece and (not first or piece.start(1) == k):
                # A piece is cut where the address before it ends, or its part of a longer word is no beginning.
                here = max(n - piece.end(1), done)
                if here >= n - piece.start(1):
                    break
                if here == 0 or text[here - 1] not in _LOCAL_CHARS:
                    start = here
                if here == done or n - piece.end() < done:
                    break
                k, first = piece.end(), False
                piece = _BEFORE.match(back, k)
                if piece and piece.start(1) == k:  # no separator between the two
                    break
        if start is not None:
            yield start, found.end()
            done = found.end()
            at = _SEPARATOR.search(text, done)
        else:
            at = _SEPARATOR.search(text, at.start() + 1 if at[0] == "@" else at.start() + max(1, len(at[0].rstrip()) - 1))


def _mail(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for begin, end in _addresses(text):
        address = text[begin:end]
        inside = [(begin + x.start(), begin + x.end(), "@") for x in _MAIL_AT.finditer(address)]
        inside += [(begin + x.start(), begin + x.end(), ".") for x in _ANY_DOT.finditer(address)]
        bare_at = any("at" == text[a:b].strip().lower() for a, b, c in inside if c == "@")
        dots = [text[a:b] for a, b, c in inside if c == "."]
        if bare_at and not dots:  # "look at example.com" is plain speech
            continue
        kept, at = [], -1
        for a, b, new in sorted(inside):
            if a >= at:
                kept.append((a, b, new))
                at = b
        edits += kept
    return edits


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source characters."""
    made = Rewritten(text)
    made.edit(_letters(made.text))
    made.edit(_spelled(made.text))
    made.edit([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(made.text)])
    made.edit([(m.start(), m.end(), "+") for m in _PLUS.finditer(made.text)])
    made.edit(_mail(made.text))
    if made.changed is None:
        return []
    out = []
    for start, kind, end in detect(made.text):
        a, b = int(made.start[start]), int(made.end[end - 1])
        touched = made.changed[start:end].any() or b - a != end - start
        if touched and not any(s <= a and b <= e for s, _, e in plain):
            out.append((a, kind, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the plain spans of each kind, base_sha256, spans (all), n_added.

    Offsets are code points. Null and empty texts have no spans. Rows are independent of one
    another; other columns are ignored.
    """
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                plain_at = np.flatnonzero(_PLAIN_HINT[part])
                odd_at = np.flatnonzero(_SCRIPT_HINT[part])
                low = LOWER[part].tobytes()
                rows = [np.unique(np.searchsorted(at, x, "right") - 1) for x in (plain_at, odd_at)]
                n = j - i
                plain, odd = set(rows[0].tolist()), set(rows[1].tolist())
                odd |= {r for r in range(n) if r not in odd and _HINT.search(low[at[r] : at[r + 1]])}  # a row must not look into its neighbours
                counts = np.zeros((4, n), np.int64)
                added = np.zeros(n, np.int64)
                base, spans = [empty] * n, [""] * n
                raw = part.tobytes()
                for r in sorted(plain | odd):
                    text = raw[at[r] : at[r + 1]].decode()
                    seen = detect(text) if r in plain else []
                    more = disguised(text, seen) if r in odd else []
                    for _, kind, _ in seen:
                        counts[kind, r] += 1
                    added[r] = len(more)
                    if seen:
                        base[r] = hashlib.sha256(joined(seen).encode()).hexdigest()
                    spans[r] = joined(seen + more)
                yield pa.record_batch([batch.column(0).slice(i, n), *(pa.array(c) for c in counts), pa.array(base), pa.array(spans), pa.array(added)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
