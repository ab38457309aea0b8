"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network.

Each kind of value is validated, numbered within the finite set of valid values of its format, permuted in that set, and
written back in its own layout. So a pseudonym is valid again, two values get the same pseudonym only if they are equal,
and with the same key equal values stay linked across documents, runs and layouts. With the key ``reveal`` undoes it.

Kinds: payment cards (13 to 19 digits, Luhn; first digit kept, check digit renewed), IBANs (mod 97; country, length and
letters kept, check digits renewed), US social security numbers, phone numbers (North American with area and exchange
rules, also as ten digits in a row; others in +international form, first two digits kept), IPv4 addresses, dates from
1900 to 2099 (year-month-day, day-month-year, unambiguous month-day-year, with or without leading zeros, English month
names; equal dates are linked whatever their layout), and the local parts of e-mail addresses, letter for letter and
digit for digit. Of a card, IBAN or phone number whose match is not valid in full, the longest valid run of leading
groups counts. What does not validate is left as it stands.

Defined cases: null stays null and empty empty, with no spans; a date like 04/05/2020 is read day first; a date without
leading zeros may come back with them; the earliest
match wins where two overlap, and of those the kind that stands first in KINDS; the format's rare fixed points may map
a value to itself; repeated rows are treated alike; further columns are ignored.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
MONTHS = "January February March April May June July August September October November December".split()
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
IBAN_LETTERS = str.maketrans({chr(c): str(c - 55) for c in range(65, 91)})


class Feistel:
    """Keyed permutations of range(n) for any n, by cycle walking over a balanced network of enough bits."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, r: int, x: int, size: int) -> int:
        h = hashlib.blake2b(f"{kind}|{n}|{r}|{x}".encode(), key=self.key, digest_size=min(64, (size + 7) // 8 + 8))
        return int.from_bytes(h.digest(), "big") & ((1 << size) - 1)

    def _step(self, kind: str, n: int, x: int, half: int, back: bool) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ self._round(kind, n, r, a, half), a) if back else (b, a ^ self._round(kind, n, r, b, half))
        return a << half | b

    def permute(self, kind: str, x: int, n: int, back: bool = False) -> int:
        if n <= 1:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        x = self._step(kind, n, x, half, back)
        while x >= n:
            x = self._step(kind, n, x, half, back)
        return x


def _refill(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(str(c) for c in range(10) if luhn(f"{body}{c}"))


Permute = Callable[[str, int, int], int]


def _card(text: str, permute: Permute) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or digits[0] not in "23456" or len(set(digits)) == 1:
        return None
    n = len(digits) - 2
    body = digits[0] + str(permute("card" + digits[0], int(digits[1:-1]), 10**n)).zfill(n)
    return _refill(text, body + _luhn_digit(body))


def _iban_check(country: str, bban: str) -> str:
    return f"{98 - int((bban + country + '00').translate(IBAN_LETTERS)) % 97:02d}"


def _iban(text: str, permute: Permute) -> str | None:
    plain = text.replace(" ", "")
    country, check, bban = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, bban) != check:
        return None
    digits = re.sub(r"\D", "", bban)
    new = str(permute(f"iban{country}", int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else ""
    new_bban = _refill(bban, new)
    it = iter(country + _iban_check(country, new_bban) + new_bban)
    return "".join(c if c == " " else next(it) for c in text)


_SSN_AREAS = [a for a in range(1, 900) if a != 666]
_SSN_PLACE = {a: i for i, a in enumerate(_SSN_AREAS)}


def _ssn(text: str, permute: Permute) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area not in _SSN_PLACE or not group or not serial:
        return None
    x = permute("ssn", (_SSN_PLACE[area] * 99 + group - 1) * 9999 + serial - 1, len(_SSN_AREAS) * 99 * 9999)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{_SSN_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, permute: Permute) -> str | None:
    digits = re.sub(r"\D", "", text)
    if text[0] == "+" and digits[0] != "1":
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 2
        return _refill(text, digits[:2] + str(permute("phone" + digits[:2], int(digits[2:]), 10**n)).zfill(n))
    lead, rest = digits[:-10], digits[-10:]
    if lead not in ("", "1") or len(rest) != 10 or rest[0] in "01" or rest[3] in "01":
        return None
    x = permute("phone1", ((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10000 + int(rest[6:]), 800 * 800 * 10000)
    x, line = divmod(x, 10000)
    area, exchange = divmod(x, 800)
    return _refill(text, f"{lead}{area + 200}{exchange + 200}{line:04d}")


def _ip(text: str, permute: Permute) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def _date(y: int, m: int, d: int) -> int | None:
    try:
        day = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


#: Days of each month from the 13th on, summed up: the dates that are read alike day first and month first.
_LATE = list(itertools.accumulate(((dt.date(1900 + (k + 1) // 12, (k + 1) % 12 + 1, 1) - dt.timedelta(1)).day - 12 for k in range(200 * 12)), initial=0))


def _moved(day: int, permute: Permute) -> dt.date:
    """The date's pseudonym, the same in every layout: up to the 12th and from the 13th on, days keep to themselves, so that it can be read back."""
    date = dt.date.fromordinal(day)
    month = (date.year - 1900) * 12 + date.month - 1
    if date.day <= 12:
        month, place = divmod(permute("early date", month * 12 + date.day - 1, 200 * 12 * 12), 12)
        return dt.date(1900 + month // 12, month % 12 + 1, place + 1)
    x = permute("late date", _LATE[month] + date.day - 13, _LATE[-1])
    month = bisect.bisect_right(_LATE, x) - 1
    return dt.date(1900 + month // 12, month % 12 + 1, x - _LATE[month] + 13)


def _number_date(text: str, permute: Permute) -> str | None:
    a, sep, b, _, c = re.split(r"([-/.])", text)
    two = "02d" if min(len(a), len(b), len(c)) == 2 else "d"
    if len(a) == 4:
        day, layout = _date(int(a), int(b), int(c)), f"{{y}}{sep}{{m:{two}}}{sep}{{d:{two}}}"
    else:
        day, layout = _date(int(c), int(b), int(a)), f"{{d:{two}}}{sep}{{m:{two}}}{sep}{{y}}"
        if day is None:
            day, layout = _date(int(c), int(a), int(b)), f"{{m:{two}}}{sep}{{d:{two}}}{sep}{{y}}"
    if day is None:
        return None
    new = _moved(day, permute)
    return layout.format(y=new.year, m=new.month, d=new.day)


def _named_date(text: str, permute: Permute) -> str | None:
    words = re.findall(r"\w+", text)
    month_first = words[0].isalpha()
    month, d = (words[0], words[1]) if month_first else (words[1], words[0])
    day = _date(int(words[2]), MONTHS.index(month) + 1, int(d))
    if day is None:
        return None
    new = _moved(day, permute)
    name = MONTHS[new.month - 1]
    return f"{name} {new.day}{',' if ',' in text else ''} {new.year}" if month_first else f"{new.day} {name} {new.year}"


def _email(text: str, permute: Permute) -> str | None:
    local, _, domain = text.partition("@")
    sets = [("abcdefghijklmnopqrstuvwxyz", c) if "a" <= c <= "z" else ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", c) if "A" <= c <= "Z" else ("0123456789", c) if c.isdigit() else (c, c) for c in local]
    n = x = 0
    n = 1
    for letters, c in sets:
        x, n = x * len(letters) + letters.index(c), n * len(letters)
    shape = "".join(s[0][0] if len(s[0]) > 1 else s[0] for s in sets)
    x = permute(f"email{shape}@{domain.lower()}", x, n)
    out = []
    for letters, _ in reversed(sets):
        x, k = divmod(x, len(letters))
        out.append(letters[k])
    return "".join(reversed(out)) + "@" + domain


_MONTH = "|".join(MONTHS)
#: Kind, pattern and rewriter; patterns only propose, rewriters validate.
KINDS: tuple[tuple[str, str, Callable[[str, Permute], str | None]], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}\b", _email),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("date", r"(?<![\w./-])(?:(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2})(?![\w/-]|\.[0-9])", _number_date),
    ("date", rf"\b(?:[0-9]{{1,2}} (?:{_MONTH}) (?:19|20)[0-9]{{2}}|(?:{_MONTH}) [0-9]{{1,2}},? (?:19|20)[0-9]{{2}})\b", _named_date),
    ("ssn", r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("ip", r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]|[\w-])", _ip),
    ("phone", r"(?<![\w.])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w.])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})){2,6}(?![\w-])|(?<![\w.+-])[2-9][0-9]{2}[2-9][0-9]{6}(?![\w-]|\.[0-9])", _phone),
    ("card", r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", _card),
)
#: Kinds whose numbers are written in groups, so that a match may take in groups that follow the number.
GROUPED = frozenset(["card", "iban", "phone"])
_PATTERN = re.compile("|".join(f"(?P<k{n}>{re.sub(chr(92) + chr(92) + '([12])', lambda m, n=n: f'(?P=s{n}{m[1]})', p)})" for n, (_, p, _) in enumerate((k, re.sub(r'\(\[-/\.\]\)', lambda m, c=iter('12'), n=i: f'(?P<s{n}{next(c)}>[-/.])', p), f) for i, (k, p, f) in enumerate(KINDS))))
_HINT = re.compile(r"[0-9@]")


#: Characters after a value that its check for ambiguity sees, more than any number's pattern reaches.
AHEAD = 128
_SINGLE = [re.compile(p) for _, p, _ in KINDS]


def _same(kind: str, x: int, n: int) -> int:
    return x


def _whole(text: str, start: int) -> int | None:
    """The end of a number with groups that is valid in its full length at this place."""
    ends = [x.end() for (kind, _, f), p in zip(KINDS, _SINGLE, strict=True) if kind in GROUPED and (x := p.match(text, start)) and f(x[0], _same) is not None]
    return max(ends, default=None)


def _shorter(text: str, start: int) -> tuple[int, int] | None:
    """(kind's place, end) of the longest valid run of leading groups of a number whose full length is not valid.

    A longer number that is valid in its full length and begins at one of the groups comes first.
    """
    for n, ((kind, _, f), p) in enumerate(zip(KINDS, _SINGLE, strict=True)):
        if kind not in GROUPED or not (m := p.match(text, start)):
            continue
        for k in range(m.end() - 1, start, -1):
            if text[k] in " -" and p.fullmatch(text, start, k) and f(text[start:k], _same) is not None:
                later = (_whole(text, j + 1) for j in range(start, k) if text[j] in " -")
                return None if any(end and end > k for end in later) else (n, k)
    return None


def _find(text: str, at: int) -> tuple[int, int, int, bool] | None:
    """(start, end, kind's place, whether a failed candidate overlaps) of the first value from ``at`` on."""
    failed = -1
    while m := _PATTERN.search(text, at):
        n = next(i for i in range(len(KINDS)) if m[f"k{i}"] is not None)
        start = m.start()
        if KINDS[n][2](m[0], _same) is not None:
            return start, m.end(), n, start < failed
        for i, p in enumerate(_SINGLE):  # another kind at the same place
            if (x := p.match(text, start)) and KINDS[i][2](x[0], _same) is not None:
                return start, x.end(), i, True
        if found := _shorter(text, start):
            return start, found[1], found[0], True
        failed = max(failed, m.end())
        at = start + 1
        while at < m.end() and text[at - 1].isalnum():
            at += 1
    return None


def rewrite(text: str, permute: Permute) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its values permuted, and (start, end, kind) of each in the original.

    Where a number stands in a longer candidate that is not valid, its pseudonym must not make the candidate valid, or it
    could not be read back: it is permuted again until that is so, and may there differ from that of an equal number elsewhere.
    """
    if not _HINT.search(text):
        return text, []
    out, spans, at = [], [], 0
    while hit := _find(text, at):
        start, end, n, unsure = hit
        kind, _, f = KINDS[n]
        new = f(text[start:end], permute)
        low = max(0, at - 1)
        while unsure and kind in GROUPED and _find(text[low:start] + new + text[end : end + AHEAD], at - low)[:3] != (start - low, start - low + len(new), n):
            new = f(new, permute)
        out += [text[at:start], new]
        spans.append((start, end, kind))
        at = end
    out.append(text[at:])
    return "".join(out), spans


def permuter(key: bytes, back: bool = False) -> Permute:
    feistel = Feistel(key)
    return lambda kind, x, n: feistel.permute(kind, x, n, back)


def reveal(text: str, key: bytes) -> str:
    """The original of a rewritten text."""
    return rewrite(text, permuter(key, True))[0]


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_replaced, spans (start, end, kind: places in the original text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = permuter(key)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            done = [(None, []) if t is None else rewrite(t, permute) for t in batch["text"].to_pylist()]
            spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in done], kind)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([t for t, _ in done], pa.string()), pa.array([len(s) for _, s in done], pa.int64()), spans], ["doc_id", "text", "n_replaced", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(rows, "doc_id long, text string, n_replaced long, spans array<struct<start: int, end: int, kind: string>>")
