"""Operator 8: format-preserving Feistel pseudonyms for personal data.

Validated numbers, addresses and dates are read as an integer in a mixed-radix domain that their format allows, the
integer is permuted by a keyed Feistel network with cycle walking, and the result is written in the same format. The
map depends on the value alone, so equal values stay linked across documents, and who has the key can turn it back.
"""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglake.llm.common import table

ROUNDS = 10
SLICE = 500
#: Smaller domains are widened where the format allows it: in them, values would too often stay as they are.
LEAST_DOMAIN = 1_000_000
#: Days of these years are permuted among themselves, and all other days of the years 1 to 9999 among themselves.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)

#: No pseudonym is sought in a text without one of these characters.
HINT = re.compile(r"[0-9@=]")
#: In order of rank: where matches overlap, the earlier kind wins.
PATTERNS: dict[str, re.Pattern[str]] = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "secret": re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|api[_-]?key|password)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([a-z0-9_\-]{12,})|(?<![A-Za-z0-9])(?-i:AKIA|ASIA|sk-)([A-Za-z0-9]{16,})(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    "date": re.compile(r"(?<![\d/.-])(?:\d{4}(?:-\d{2}-|/\d{2}/)\d{2}|\d{2}(?:/\d{2}/|\.\d{2}\.|-\d{2}-)\d{4})(?![/-]?\d)"),
    "card": re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
}

#: Digits with at most one separator between two; card numbers are sought at its groups' bounds.
DIGIT_RUN = re.compile(r"(?<!\d)\d(?:[ -]?\d)*")
#: Digits of the groups in which cards are printed.
CARD_GROUPS = re.compile(r"1[3-9]|4,4,4,4(?:,[123])?|4,6,[45]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}")
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
ANY = re.compile(r"(?s).*")


class Feistel:
    """A keyed permutation of the integers below any n."""

    def __init__(self, key: bytes):
        if not 16 <= len(key) <= 64:
            raise ValueError("the key must have 16 to 64 bytes")
        self.key = key
        self._round = lru_cache(maxsize=100_000)(self._f)

    def _f(self, tag: str, half: int, r: int, x: int) -> int:
        size = (half + 7) // 8
        h = blake2b(x.to_bytes(size, "big"), key=self.key, digest_size=min(64, size + 8), person=f"{tag[:8]}:{half}:{r}".encode()[:16])
        data = h.digest()
        while len(data) < size:
            data += blake2b(data, key=self.key).digest()
        return int.from_bytes(data, "big") & ((1 << half) - 1)

    def permute(self, x: int, n: int, tag: str, back: bool = False) -> int:
        if n < 2:
            return x
        half = max(1, (n - 1).bit_length() + 1 >> 1)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            if back:
                for r in range(ROUNDS - 1, -1, -1):
                    a, b = b ^ self._round(tag, half, r, a), a
            else:
                for r in range(ROUNDS):
                    a, b = b, a ^ self._round(tag, half, r, b)
            x = a << half | b
            if x < n:
                return x

    def digits(self, values: list[int], radixes: list[int], tag: str, back: bool = False) -> list[int]:
        """Permute a mixed-radix number given digit by digit, most significant first."""
        x, n = 0, 1
        for v, r in zip(values, radixes, strict=True):
            x, n = x * r + v, n * r
        x, out = self.permute(x, n, tag, back), []
        for r in reversed(radixes):
            x, v = divmod(x, r)
            out.append(v)
        return out[::-1]


def radix_of(c: str) -> tuple[int, int] | None:
    """Value and radix of an ASCII letter (case apart) or digit, else None."""
    if "0" <= c <= "9":
        return ord(c) - 48, 10
    low = c.lower()
    return (ord(low) - 97, 26) if "a" <= low <= "z" and c.isascii() else None


def written_as(c: str, v: int, r: int) -> str:
    return chr(48 + v) if r == 10 else chr((65 if c.isupper() else 97) + v)


def alnum(f: Feistel, text: str, places: list[int], tag: str, back: bool) -> str:
    """Permute the letters and digits at ``places``; all else, and each one's class and case, stays."""
    at = [i for i in places if radix_of(text[i])]
    pairs = [radix_of(text[i]) for i in at]
    new = f.digits([v for v, _ in pairs], [r for _, r in pairs], f"{tag}{len(at)}", back)
    out = list(text)
    for i, v, (_, r) in zip(at, new, pairs, strict=True):
        out[i] = written_as(text[i], v, r)
    return "".join(out)


def email(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Local part and the host's labels before the last two; where these are few, the last but one as well."""
    text = m[0]
    host = text.index("@") + 1
    dots = [i for i in range(host, len(text)) if text[i] == "."]
    for end in (dots[-2] if len(dots) > 1 else host, dots[-1]):
        size = 1
        for i in range(end):
            size *= (radix_of(text[i]) or (0, 1))[1]
        if size >= LEAST_DOMAIN:
            break
    return alnum(f, text, list(range(end)), "email", back)


def secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    group = 1 if m[1] else 2
    value, at = m[group], m.start(group) - m.start()
    if not any(c.isdigit() for c in value):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        new = f.digits([int(c, 16) for c in value], [16] * len(value), f"hex{len(value)}", back)
        low = "".join("0123456789abcdef"[v] for v in new)
        return m[0][:at] + (low.upper() if any(c.isupper() for c in value) else low)
    return m[0][:at] + alnum(f, value, list(range(len(value))), "secret", back)


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    bare = m[0].replace(" ", "")
    if not 15 <= len(bare) <= 34 or mod97(bare[4:] + bare[:4]) != 1:
        return None
    body = alnum(f, bare[4:], list(range(len(bare) - 4)), "iban" + bare[:2], back)
    new = iter(bare[:2] + f"{98 - mod97(body + bare[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in m[0])


def ip(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    low, size = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    new = f.digits([int(p) - low[len(p)] for p in parts], [size[len(p)] for p in parts], "ip" + "".join(str(len(p)) for p in parts), back)
    return ".".join(str(v + low[len(p)]) for v, p in zip(new, parts, strict=True))


def moved(f: Feistel, d: date, back: bool) -> date:
    common, x = (LAST_DAY - FIRST_DAY).days + 1, d.toordinal() - 1
    if FIRST_DAY <= d <= LAST_DAY:
        return FIRST_DAY + timedelta(f.permute((d - FIRST_DAY).days, common, "date", back))
    early = FIRST_DAY.toordinal() - 1
    x = f.permute(x if x < early else x - common, date.max.toordinal() - common, "day", back)
    return date.fromordinal((x if x < early else x + common) + 1)


def day(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Year first, or day first where that is a calendar date, else month first; what is read month first moves on until its day shows that again."""
    year_first = not m[0][4].isdigit()
    sep = m[0][4 if year_first else 2]
    x = [int(p) for p in m[0].split(sep)]
    for order in ((0, 1, 2),) if year_first else ((2, 1, 0), (2, 0, 1)):
        try:
            new = moved(f, date(*(x[k] for k in order)), back)
        except ValueError:
            continue
        while order == (2, 0, 1) and new.day <= 12:
            new = moved(f, new, back)
        y, mo, dd = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return sep.join({(0, 1, 2): (y, mo, dd), (2, 1, 0): (dd, mo, y), (2, 0, 1): (mo, dd, y)}[order])
    return None


def luhn(digits: list[int]) -> int:
    """The check digit of the digits before it."""
    return -sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10


def refill(text: str, digits: list[int]) -> str:
    new = iter(digits)
    return "".join(str(next(new)) if c.isdigit() else c for c in text)


def card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = [int(c) for c in m[0] if c.isdigit()]
    if luhn(digits[:-1]) != digits[-1]:
        return None
    new = f.digits(digits[:-1], [10] * (len(digits) - 1), f"card{len(digits)}", back)
    return refill(m[0], [*new, luhn(new)])


def phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    """North American numbers keep valid area and exchange codes; others keep their country code."""
    text, digits = m[0], [int(c) for c in m[0] if c.isdigit()]
    if not 8 <= len(digits) <= 15:
        return None
    keep = 0
    if text[0] == "+":
        code = re.match(r"\+(\d{1,3})(?!\d)", text)
        keep = len(code[1]) if code else 1 if digits[0] in (1, 7) else 2
    body = digits[keep:]
    radixes = [10] * len(body)
    if len(body) == 10 and (not keep or digits[:keep] == [1]):
        if body[0] < 2 or body[3] < 2:
            return None
        radixes[0] = radixes[3] = 8
    shift = [10 - r for r in radixes]
    new = f.digits([d - s for d, s in zip(body, shift, strict=True)], radixes, f"phone{len(body)}", back)
    return refill(text, digits[:keep] + [d + s for d, s in zip(new, shift, strict=True)])


def ssn(f: Feistel, m: re.Match, back: bool) -> str | None:
    a, b, c = (int(p) for p in m[0].split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not b or not c:
        return None
    a, b, c = f.digits([areas.index(a), b - 1, c - 1], [len(areas), 99, 9999], "ssn", back)
    return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"


KINDS: dict[str, Callable[[Feistel, re.Match, bool], str | None]] = {
    "email": email, "secret": secret, "iban": iban, "ip": ip, "date": day, "card": card, "phone": phone, "ssn": ssn,
}


def iban_readings(text: str) -> Iterator[re.Match]:
    """From each start: as many characters as the country's have, then the longest run of groups and its prefixes."""
    for start in IBAN_START.finditer(text):
        at = start.start()
        if (n := IBAN_LENGTHS.get(start[0][:2])) and (m := re.compile(rf"[A-Z0-9](?: ?[A-Z0-9]){{{n - 1}}}(?![A-Za-z0-9])").match(text, at)):
            yield m
        if m := PATTERNS["iban"].match(text, at):
            yield m
            if n is None:
                for end in range(m.end() - 1, at, -1):
                    if text[end] == " " and (part := PATTERNS["iban"].fullmatch(text, at, end)):
                        yield part


def card_readings(text: str) -> Iterator[re.Match]:
    """All readings of 13 to 19 digits that start and end with groups: first those in printed groups, longer before shorter."""
    for run in DIGIT_RUN.finditer(text):
        groups = [(m.start(), m.end()) for m in re.compile(r"\d+").finditer(text, run.start(), run.end())]
        found = []
        for i, (a, _) in enumerate(groups):
            digits, sizes = 0, []
            for x, b in groups[i : i + 19]:
                digits += b - x
                sizes.append(str(b - x))
                if digits > 19:
                    break
                if digits >= 13:
                    found.append((not CARD_GROUPS.fullmatch(",".join(sizes)), -digits, a, b))
        for _, _, a, b in sorted(found):
            yield PATTERNS["card"].fullmatch(text, a, b)


#: Of these kinds a reading that fails its validation leaves room for others within it or across its end.
READINGS: dict[str, Callable[[str], Iterator[re.Match]]] = {"iban": iban_readings, "card": card_readings}


def replaced_at(f: Feistel, text: str, spans: list[dict]) -> str:
    """The text with the values in place of the pseudonyms at the given places."""
    out, last = [], 0
    for x in sorted(spans, key=lambda x: x["start"]):
        a, b = x["start"], x["start"] + x["length"]
        m = PATTERNS[x["kind"]].fullmatch(text, a, b) or ANY.fullmatch(text, a, b)
        new = KINDS[x["kind"]](f, m, True) if m else None
        if new is not None:
            out += [text[last:a], new]
            last = b
    return "".join([*out, text[last:]])


def replaced(f: Feistel, text: str, kinds: tuple[str, ...] = tuple(KINDS), back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and start, length and kind of each."""
    if not HINT.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind in kinds:
        for m in READINGS.get(kind, PATTERNS[kind].finditer)(text):
            if taken.find(1, m.start(), m.end()) < 0 and (new := KINDS[kind](f, m, back)) is not None:
                found.append((m.start(), m.end(), kind, new))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    out, last = [], 0
    for a, b, _, new in sorted(found):
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), [(a, b - a, kind) for a, b, kind, _ in sorted(found)]


def pseudonymise(
    docs: DataFrame, key: bytes, *, kinds: tuple[str, ...] = tuple(KINDS), text_col: str = "text", back: bool = False
) -> DataFrame:
    """Replaces the text and adds ``pii``: start, length (in characters) and kind of each pseudonym; no shuffle.

    Only values that pass their kind's validation change (calendar dates, Luhn, mod 97, octets, number plans); they
    keep length, punctuation, letter case and validity. ``back`` turns pseudonyms into the values again: at the
    places in ``pii`` where the forward run's column is there, else at those read anew, which can differ for card
    numbers beside other digits, as one reading in ten passes Luhn by chance. A permutation
    may map a value to itself; domains are kept large enough to make that rare.

    Null texts stay null with an empty list, empty texts stay empty. Repeated rows and extra columns stay as they are;
    an existing column ``pii`` is replaced.
    """
    base = docs.drop("pii").withColumn("pii", F.array().cast("array<struct<start:int,length:int,kind:string>>"))
    t, p = base.columns.index(text_col), base.columns.index("pii")
    known = [f.name for f in docs.schema if f.name == "pii" and f.dataType == base.schema["pii"].dataType] if back else []
    if known:
        base = docs.select(*[c for c in docs.columns if c != "pii"], "pii")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts, pii = [], []
                places = batch.column(p).to_pylist() if known else [None] * batch.num_rows
                for text, spans in zip(batch.column(t).to_pylist(), places, strict=True):
                    if text is None:
                        new, found = None, []
                    elif spans is None:
                        new, found = replaced(f, text, kinds, back)
                    else:
                        spans = [x for x in spans if x["kind"] in kinds]
                        new, found = replaced_at(f, text, spans), [(x["start"], x["length"], x["kind"]) for x in spans]
                    texts.append(new)
                    pii.append([{"start": a, "length": n, "kind": k} for a, n, k in found])
                for i, v in ((t, texts), (p, pii)):
                    field = batch.schema.field(i)
                    batch = batch.set_column(i, field, pa.array(v, field.type))
                yield batch

    return base.mapInArrow(run, schema)


#: Session setting with the key in hexadecimal digits; Spark redacts settings of such names in its logs.
KEY_SETTING = "spark.listinglake.pseudonyms.secret"


def session_key(spark: SparkSession) -> bytes:
    """The key that the caller has set in the session, or else a random one, which stays in the session to turn its pseudonyms back.

    What a random key has replaced cannot be linked or turned back once the session has ended, so a warning tells of it.
    """
    if not spark.conf.get(KEY_SETTING, None):
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms of a random key are lost with this session", stacklevel=2)
        spark.conf.set(KEY_SETTING, os.urandom(32).hex())
    return bytes.fromhex(spark.conf.get(KEY_SETTING))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",")
    return out.select("doc_id", F.size("pii").cast("long").alias("n_pii"), kinds.alias("kinds"), "text")
