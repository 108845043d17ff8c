"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from premia.llm.common import fresh, small_batches

ROUNDS = 8

# ISO 13616 lengths of account numbers by country, as far as the register lists them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _iban_shape() -> str:
    """Per country its length of letters and digits, with or without spaces between groups of four, and nothing after it."""
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    kinds = []
    for length, countries in sorted(by_length.items()):
        fours, rest = divmod(length - 4, 4)
        tail = f"(?: ?[A-Z0-9]{{{rest}}})" if rest else ""
        kinds.append(rf"(?:{'|'.join(countries)})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    return rf"(?<![\w])(?:{'|'.join(kinds)})(?![\w])"


# ITU E.164 country codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58,
                   60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}

# What each kind of datum looks like, in the order of preference at one place.
SHAPES = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w])",
    "iban": _iban_shape(),
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w]|[.-]\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w]|[.-]\d)"
             r"|(?<![\w.+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w]|[.-]\d)",
}
_FOUND = {kind: re.compile(shape, re.ASCII) for kind, shape in SHAPES.items()}
_ANY = re.compile("|".join(f"(?P<{kind}>{re.sub(r'\\([12])', lambda m: '\\' + {'1': '6', '2': '7'}[m[1]], shape)})"
                           for kind, shape in SHAPES.items()), re.ASCII)
_HINT = re.compile(r"@|\d", re.ASCII)


class Feistel:
    """A keyed permutation of 0 … size - 1 without fixed points, one for each purpose and size."""

    def __init__(self, key: bytes):
        self.key = key
        self.pseudonym = lru_cache(maxsize=100_000)(self._pseudonym)

    def _walk(self, value: int, size: int, purpose: str, back: bool) -> int:
        low = math.isqrt(size - 1) + 1
        high = -(-size // low)
        while True:
            left, right = divmod(value, low)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                tag = f"{purpose}|{size}|{i}|{left if i % 2 else right}".encode()
                step = int.from_bytes(hashlib.blake2b(tag, key=self.key, digest_size=32).digest(), "big")
                step = -step if back else step
                if i % 2:
                    right = (right + step) % low
                else:
                    left = (left + step) % high
            value = left * low + right
            if value < size:
                return value

    def _pseudonym(self, value: int, size: int, purpose: str) -> int:
        """One step along a keyed cycle through all values: never the value itself when there are two or more."""
        if size < 2:
            return value
        return self._walk((self._walk(value, size, purpose, False) + 1) % size, size, purpose, True)


def luhn(digits: str) -> int:
    """The check digit after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def spread_digits(shape: str, digits: str) -> str:
    """``digits`` in the places that ``shape`` has for digits."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape, flags=re.ASCII)


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _classes(text: str, f: Feistel, purpose: str) -> str:
    """Permute letters and digits, each within its class, as one number; other signs stay."""
    sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
    value, size = 0, 1
    for c, n in zip(text, sizes):
        value = value * n + (int(c) if n == 10 else ord(c.lower()) - 97 if n == 26 else 0)
        size *= n
    value = f.pseudonym(value, size, purpose)
    out = []
    for c, n in zip(reversed(text), reversed(sizes)):
        value, d = divmod(value, n)
        out.append(str(d) if n == 10 else chr(d + (65 if c.isupper() else 97)) if n == 26 else c)
    return "".join(reversed(out))


def _email(s: str, f: Feistel) -> str | None:
    name, _, host = s.partition("@")
    return _classes(name, f, "email@" + host.lower()) + "@" + host


def _iban(s: str, f: Feistel) -> str | None:
    plain = s.replace(" ", "")
    country, account = plain[:2], plain[4:]
    if IBAN_LENGTHS.get(country) != len(plain) or f"{iban_check(country, account):02}" != plain[2:4]:
        return None
    new = _classes(account, f, "iban" + country)
    it = iter(f"{country}{iban_check(country, new):02}{new}")
    return "".join(c if c == " " else next(it) for c in s)


@lru_cache(maxsize=64)
def _days(century: int) -> tuple[list[int], list[int]]:
    """Ordinals of the century's days: up to the 12th of their month, and later ones."""
    first, last = datetime.date(century, 1, 1).toordinal(), datetime.date(century + 99, 12, 31).toordinal()
    early: list[int] = []
    late: list[int] = []
    for n in range(first, last + 1):
        (late if datetime.date.fromordinal(n).day > 12 else early).append(n)
    return early, late


def _date(s: str, f: Feistel) -> str | None:
    """Another day of the century, in all styles the same for the same day.

    A day up to the 12th of its month stays one, and so does a later one. So slashes keep their reading: month first
    where that is a date, else day first, and different strings stay different.
    """
    styles = ["%Y-%m-%d"] if s[4] == "-" else ["%d.%m.%Y"] if s[2] == "." else ["%m/%d/%Y", "%d/%m/%Y"]
    for style in styles:
        try:
            day = datetime.datetime.strptime(s, style).date()
            break
        except ValueError:
            continue
    else:
        return None
    if day.year < 100:
        return None
    century = day.year // 100 * 100
    late = day.day > 12
    days = _days(century)[late]
    new = datetime.date.fromordinal(days[f.pseudonym(bisect.bisect_left(days, day.toordinal()), len(days), f"date{century}/{late}")])
    return style.replace("%Y", f"{new.year:04}").replace("%m", f"{new.month:02}").replace("%d", f"{new.day:02}")


def _ip(s: str, f: Feistel) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in s.split(".")):
        return None
    new = f.pseudonym(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def _card(s: str, f: Feistel) -> str | None:
    digits = re.sub(r"\D", "", s)
    if luhn(digits[:-1]) != int(digits[-1]) or digits[0] == "0":
        return None
    n = len(digits) - 2
    body = digits[0] + f"{f.pseudonym(int(digits[1:-1]), 10**n, 'card' + digits[0]):0{n}}"
    return spread_digits(s, body + str(luhn(body)))


def _ssn(s: str, f: Feistel) -> str | None:
    area, group, serial = map(int, s.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    at = f.pseudonym((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn")
    at, serial = divmod(at, 9999)
    area, group = divmod(at, 99)
    return f"{areas[area]:03}-{group + 1:02}-{serial + 1:04}"


def _phone(s: str, f: Feistel) -> str | None:
    """The country code stays; a number without one is of country 1, so it goes with the same number that has it.

    Ten digits of country 1 whose area and exchange codes begin with 2 to 9 are permuted among such numbers, other ten
    digits among the others, and numbers of any other country among those of equal length.
    """
    digits = re.sub(r"\D", "", s)
    if not 7 <= len(digits) <= 15:
        return None
    code = 0 if s[0] != "+" else 1 if digits[0] in "17" else 2 if int(digits[:2]) in TWO_DIGIT_CODES else 3
    country, own = digits[:code], digits[code:]
    if country in ("", "1") and len(own) == 10:
        dialled = min(own[0], own[3]) > "1"
        pairs = [a + b for a in "0123456789" for b in "0123456789" if (min(a, b) > "1") == dialled]
        value = pairs.index(own[0] + own[3]) * 10**8 + int(own[1:3] + own[4:])
        pair, rest = divmod(f.pseudonym(value, len(pairs) * 10**8, f"phone1/{dialled}"), 10**8)
        new = f"{pairs[pair][0]}{rest // 10**6:02}{pairs[pair][1]}{rest % 10**6:06}"
    else:
        new = f"{f.pseudonym(int(own), 10 ** len(own), f'phone{country}/{len(own)}'):0{len(own)}}"
    return spread_digits(s, country + new)


RULES: dict[str, Callable[[str, Feistel], str | None]] = {
    "email": _email, "iban": _iban, "date": _date, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone,
}


def replace(text: str, f: Feistel) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, length, kind) of what was replaced, in the old text."""
    out, spans, at, tried = [], [], 0, 0
    for hint in _HINT.finditer(text):
        if hint.start() < tried:
            continue
        # Every datum has a digit or an @ in its first word, so only the starts up to there are tried, each once.
        word = max(text.rfind(" ", tried, hint.start()), text.rfind("\n", tried, hint.start())) + 1
        start, tried = max(word, tried), hint.start() + 1
        for start in range(start, tried):
            if found := _datum(text, start, f):
                stop, new, kind = found
                out += [text[at:start], new]
                spans.append((start, stop - start, kind))
                at = tried = stop
                break
    return "".join(out) + text[at:], spans


def _datum(text: str, start: int, f: Feistel) -> tuple[int, str, str] | None:
    """End, pseudonym and kind of the valid datum that begins at ``start``."""
    if _ANY.match(text, start):
        for kind, shape in _FOUND.items():
            hit = shape.match(text, start)
            if hit and (new := RULES[kind](hit[0], f)) is not None:
                return hit.end(), new, kind
    return None


def pseudonymise(text: Column, key: bytes) -> Column:
    """Struct (text, spans) of each whole text; null stays null."""

    @pandas_udf("text string, spans array<struct<start:int,length:int,kind:string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        f = Feistel(key)
        done = [(None, []) if t is None else replace(t, f) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done],
                             "spans": [[{"start": a, "length": n, "kind": k} for a, n, k in s] for _, s in done]})

    return run(text)


def replace_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: bytes) -> DataFrame:
    """One row per document: id, ``text`` with pseudonyms, ``n_found``, ``spans`` (start, length, kind).

    Card numbers (Luhn), account numbers (ISO 13616: length of the country, check digits), social security numbers, phone numbers, IPv4
    addresses, calendar dates and the names in e-mail addresses are replaced by another value of the same
    format that passes the same checks. A value always gets the same pseudonym under a key, and different values
    different ones, so links between documents stay; so they do between styles of a date and between phone numbers with and
    without country code 1. Left as they are: IPv6 addresses, dates with month names, one-digit parts or a time
    right behind them, account numbers in lower case, ten digits in a row. Numbers that fail their checks stay as they are. Null
    texts stay null with nothing found; empty texts stay empty; repeated rows give one row each; extra
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    said = fresh(docs, "said")
    return docs.select(F.col(id_col), pseudonymise(F.col(text_col).cast("string"), key).alias(said)).select(
        id_col, F.col(f"{said}.text").alias("text"), F.size(f"{said}.spans").alias("n_found"), F.col(f"{said}.spans").alias("spans"))
