"""Personal data: validated numbers and dates become format-preserving Feistel pseudonyms."""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: The setting that holds the secret of the registered queries and the pipeline.
KEY_SETTING = "spark.lengthloom.pseudonyms.key"
_drawn: dict[str, bytes] = {}
ROUNDS = 8
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of 0 .. size-1 without fixed points, for each kind of number.

    Numbers split into two near-square halves; each round adds a keyed hash of one half to the other. Results beyond size go
    round again. Between the network and its inverse the number moves by one, so none stays where it was.
    """

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.a = isqrt(size - 1) + 1 if size > 1 else 1
        self.b = -(-size // self.a)
        self.hash = blake2b(kind.encode() + size.to_bytes(32, "big"), key=key[:64], digest_size=24)

    def _f(self, i: int, x: int) -> int:
        h = self.hash.copy()
        h.update(bytes([i]) + x.to_bytes(32, "big"))
        return int.from_bytes(h.digest(), "big")

    def _there(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._f(i, left)) % self.b
            else:
                left = (left + self._f(i, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._f(i, left)) % self.b
            else:
                left = (left - self._f(i, right)) % self.a
        return left * self.b + right

    def _walk(self, step, x: int) -> int:
        x = step(x)
        while x >= self.size:
            x = step(x)
        return x

    def __call__(self, x: int) -> int:
        return self._walk(self._back, (self._walk(self._there, x) + 1) % self.size)

    def undo(self, y: int) -> int:
        return self._walk(self._back, (self._walk(self._there, y) - 1) % self.size)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mixed(values: list[int], sizes: list[int]) -> int:
    x = 0
    for v, n in zip(values, sizes, strict=True):
        x = x * n + v
    return x


def unmixed(x: int, sizes: list[int]) -> list[int]:
    out = []
    for n in reversed(sizes):
        x, v = divmod(x, n)
        out.append(v)
    return out[::-1]


def into(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: What may follow or precede a number: no digit or letter.
_FREE = r"(?<![0-9A-Za-z]){}(?![0-9A-Za-z])"
#: Kinds by name, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": _FREE.format(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "key": _FREE.format(r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    "secret": r"(?i:\b(?:password|passwd|secret|token|api_?key)\b)\s*[=:]\s*[\"']?[0-9A-Za-z_+/-]{8,}",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": _FREE.format(r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})"),
    "ssn": _FREE.format(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "card": _FREE.format(r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"),
    "phone": r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
}

#: Lengths of IBANs by country.
IBAN = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 "
    "MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
#: A phone number of the plan whose numbers all have ten digits.
_TEN = re.compile(r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])")


class Pseudonyms:
    def __init__(self, key: bytes, kinds: tuple[str, ...] = tuple(PATTERNS)):
        self.key, self.kinds = key, kinds
        self.hint = re.compile("[0-9@]|A[KS]IA")  # every valid value holds one of these
        self.find = re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in kinds))
        self.one = {k: re.compile(x) for k, x in PATTERNS.items()}
        self.feistel = lru_cache(4096)(lambda kind, size: Feistel(key, kind, size))
        self.of = lru_cache(100_000)(self.replace)

    def digits(self, kind: str, d: str) -> str:
        return str(self.feistel(kind, 10 ** len(d))(int(d))).zfill(len(d))

    def characters(self, kind: str, s: str) -> str:
        """Digits, small and capital letters (hexadecimal ones as such, if the text is) move within their class."""
        alphabets = ("0123456789abcdef",) if kind == "secret" and re.fullmatch("[0-9]*[a-f][0-9a-f]*", s) else ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        places = [(i, a) for i, c in enumerate(s) for a in alphabets if c in a]
        out = list(s)
        for at in range(0, len(places), 24):
            some = places[at : at + 24]
            sizes = [len(a) for _, a in some]
            n = prod(sizes)
            value = mixed([a.index(s[i]) for i, a in some], sizes)
            if n > 1:
                moved = self.feistel(f"{kind} {sizes} {at}", n)(value)
                for (i, a), v in zip(some, unmixed(moved, sizes), strict=True):
                    out[i] = a[v]
        return "".join(out)

    def replace(self, kind: str, s: str) -> str | None:
        """The pseudonym, of the same format; None if the text isn't a valid one of its kind."""
        d = re.sub("[^0-9]", "", s)
        if kind == "email":
            name, _, host = s.partition("@")
            return f"{self.characters(kind, name)}@{host}"
        if kind == "key":
            return s[:4] + self.characters(kind, s[4:])
        if kind == "secret":
            m = re.search(r"[0-9A-Za-z_+/-]{8,}$", s)
            return s[: m.start()] + self.characters(kind, m[0]) if re.search("[0-9]", m[0]) else None
        if kind == "ipv4":
            parts = s.split(".")
            if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
                return None
            return ".".join(map(str, unmixed(self.feistel(kind, 256**4)(mixed(list(map(int, parts)), [256] * 4)), [256] * 4)))
        if kind == "date":
            sep = next(c for c in s if not c.isdigit())
            if s.count(sep) != 2:
                return None
            a, b, c = s.split(sep)
            y, m, day = (a, b, c) if sep == "-" else (c, a, b) if sep == "/" else (c, b, a)
            try:
                n = (date(int(y), int(m), int(day)) - FIRST_DAY).days
            except ValueError:
                if sep != "/":
                    return None
                try:  # day first
                    n = (date(int(y), int(day), int(m)) - FIRST_DAY).days
                except ValueError:
                    return None
                new = self._day(n)
                return None if new is None else f"{new.day:0{len(a)}d}/{new.month:0{len(b)}d}/{new.year:04d}"
            new = self._day(n)
            if new is None:
                return None
            if sep == "-":
                return f"{new.year:04d}-{new.month:02d}-{new.day:02d}"
            first, second = (new.month, new.day) if sep == "/" else (new.day, new.month)
            return f"{first:0{len(a)}d}{sep}{second:0{len(b)}d}{sep}{new.year:04d}"
        if kind == "ssn":
            area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            sizes = [898, 99, 9999]
            x, g, n = unmixed(self.feistel(kind, 898 * 99 * 9999)(mixed([area - 1 - (area > 666), group - 1, serial - 1], sizes)), sizes)
            return f"{x + 1 + (x >= 665):03d}-{g + 1:02d}-{n + 1:04d}"
        if kind == "card":
            if not luhn(d):
                return None
            body = d[0] + self.digits(kind, d[1:-1])
            return into(s, body + next(c for c in "0123456789" if luhn(body + c)))
        if kind == "iban":
            flat = s.replace(" ", "")
            number = lambda x: int("".join(str(int(c, 36)) for c in x))
            if number(flat[4:] + flat[:4]) % 97 != 1:
                return None
            body = self.characters(kind, flat[4:])
            it = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body)
            return "".join(c if c == " " else next(it) for c in s)
        if kind == "phone":
            national = d[-7:] if len(d) < 10 else d[-9:]
            if not 7 <= len(d) <= 15:
                return None
            return into(s, d[: len(d) - len(national)] + self.digits(kind, national))
        return None

    def _day(self, n: int) -> date | None:
        return FIRST_DAY + timedelta(self.feistel("date", DAYS)(n)) if 0 <= n < DAYS else None

    def _ends(self, kind: str, t: str, start: int, end: int) -> list[int]:
        """Where a value that matched from start to end may end, best first: IBANs and phone numbers run on over what follows.

        An IBAN has the length of its country. A phone number stops before a valid value of another kind and never cuts one.
        """
        if kind not in ("iban", "phone"):
            return [end]
        ends = [i for i in range(end, start, -1) if t[i - 1].isalnum() and (i == end or not t[i].isalnum()) and self.one[kind].fullmatch(t, start, i)]
        if kind == "iban":
            n = IBAN.get(t[start : start + 2])
            return [*(i for i in ends if len(t[start:i].replace(" ", "")) == n), end] if n else ends
        ten = _TEN.match(t, start)
        if ten and not self._other("date", t, ten.end() - 4):
            return [ten.end()]
        inner = []
        for i in range(start + 1, end):
            if t[i - 1] in " .-":
                for k in ("ipv4", "date") if t[i - 1] != " " else ("ipv4", "date", "ssn", "card", "phone"):
                    if (to := self._other(k, t, i)) and not (k == "card" and t[i] not in "23456"):
                        inner.append((k, i, to))
        last = max((i for k, i, _ in inner if k == "card"), default=0)
        inner = [(i, to) for k, i, to in inner if k != "card" or i == last or to <= last]
        whole = [e for e in ends if not any(i < e < to for i, to in inner)]
        return list(dict.fromkeys(e for stop in [*(i for i, _ in inner), end + 1] for e in whole if e < stop))

    def _other(self, kind: str, t: str, at: int) -> int | None:
        """The end of a valid value of a kind that begins at a place."""
        m = self.one[kind].match(t, at)
        return m.end() if m and self.of(kind, m[0]) is not None else None

    def _valid(self, t: str, m: re.Match, after: int = 0) -> tuple[str, int, int, str] | None:
        """Kind, begin, end and pseudonym of the valid value at the place of a match: of its kind or of one tried later."""
        start = m.start()
        for kind in self.kinds[self.kinds.index(m.lastgroup) :]:
            x = m if kind == m.lastgroup else self.one[kind].match(t, start)
            for end in self._ends(kind, t, start, x.end()) if x else ():
                new = self.of(kind, t[start:end])
                if new is None or end <= after:
                    continue
                if kind == "secret":  # the labelled value may be the beginning of a longer one of another kind
                    begin = start + re.search(r"[0-9A-Za-z_+/-]{8,}$", t[start:end]).start()
                    longer = self.find.match(t, begin)
                    if longer and (hit := self._valid(t, longer, end)):
                        return hit
                return kind, start, end, new
        return None

    def text(self, t: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and what was replaced: kind, begin and end in the old text."""
        out, spans, last = [], [], 0
        if not self.hint.search(t):
            return t, spans
        at = 0
        while m := self.find.search(t, at):
            hit = self._valid(t, m)
            if hit is None:  # a valid value may begin inside
                at = m.start() + 1
                continue
            kind, begin, at, new = hit
            if new != t[begin:at]:
                out += [t[last:begin], new]
                spans.append((kind, begin, at))
                last = at
        return ("".join([*out, t[last:]]) if spans else t), spans


def session_key(spark: SparkSession) -> bytes:
    """The secret that the session names, so that values stay linked across runs; else one drawn at random for the application."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """df with personal data in ``text`` replaced by keyed pseudonyms of the same format, and replaced array<struct>.

    Numbers are replaced only if they are valid: Luhn cards, IBANs by remainder, IPv4 octets, social security numbers by
    area, calendar dates (1900 to 2099), phone numbers by shape; e-mail names, cloud keys and labelled secrets move within
    their character classes. The permutation depends on key and kind alone, so equal values stay equal in all documents.
    Null texts stay null; texts without such data are unchanged; rows are independent. Other columns pass through, but
    ``replaced`` is replaced. An empty table gives no rows.
    """
    df = df.drop("replaced")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("privacy")
        p = _pseudonyms(key, kinds)
        at = names.index(text)
        for batch in C.slices(batches, at):
            texts, found = [], []
            for t in batch.column(at).to_pylist():
                new, spans = p.text(t) if t else (t, [])
                texts.append(new)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*names, "replaced"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "replaced array<struct<kind:string,start:long,end:long>>"])
    return df.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _pseudonyms(key: bytes, kinds: tuple[str, ...]) -> Pseudonyms:
    return Pseudonyms(key, kinds)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents with their texts after replacement, and how many values were replaced."""
    return pseudonymise(C.table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark)).selectExpr("doc_id", "text", "cast(size(replaced) as long) as n_replaced", "array_join(array_sort(array_distinct(replaced.kind)), ',') as kinds")
