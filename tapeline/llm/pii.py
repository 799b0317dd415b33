"""Format-preserving Feistel pseudonyms for personal data.

Validated numbers, addresses and dates are permuted within their own format by a keyed Feistel
network, so equal values get equal pseudonyms in every document, and different values different
ones, without any table or shuffle. Check digits are computed anew, dates stay dates.

Kinds: email (local part), phone (digits after the country code), ip (IPv4), card (13 to 19
digits with a valid Luhn digit; the check digit is made valid again), iban (valid mod 97), ssn,
date (ISO, or day and month and year between slashes or dots), secret (values assigned to
password, token, secret or api key, and bearer tokens), key (cloud access keys, code-host and
chat tokens by their prefixes, web tokens), ip6. A value is brought into one form before it is
permuted and goes back into the layout it had: the digits of a phone number behind its country
code, of a card or IBAN without gaps, the day of a date, the bits of an address. So spellings of
one number stay linked. Numbers that don't validate stay as they are, as do IPv4-like numbers
behind the word version. National phone numbers without separators are not found. In a small
format a value may be its own pseudonym, as in any permutation.

The key is secret and has no default: whoever has it can reverse the pseudonyms.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import secrets
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tapeline.llm import common

#: The Spark setting that holds the key; texts under one key are linked with each other.
KEY_SETTING = "spark.tapeline.pii.key"
ROUNDS = 8

_KINDS = {
    "email": r"(?<![\w.+%-])\w(?:[\w.+%'-]*\w)?@(?:[\w-]+\.)+[^\W\d_]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)[A-Za-z0-9_\-+/]{6,}|(?i:\bbearer\s+)[A-Za-z0-9._~+/-]{16,}",
    "key": r"(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]*)(?!\w)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)(?:(?:[0-9A-Fa-f]{1,4}:){1,7}:(?![\w:])|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|:(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![\w:])",
    "ip": r"(?<![\w.])(?<!(?i:version) )\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d\d-\d\d|\d{1,2}([/.])\d{1,2}\1\d{4})(?!(?!T\d\d:?\d\d)[\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])",
    "phone": r"(?<![\w+.])(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?\d{1,4}(?:[ .-]?\d{2,4}){1,3}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])(?:\d{4}([ -])(?:\d{4}\2\d{4}\2\d{4}|\d{6}\2\d{5})|\d{13,19})(?![\w-]|\.\d)",
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()).replace(r"\1", "(?P=slash)").replace("([/.])", "(?P<slash>[/.])").replace(r"\2", "(?P=gap)").replace("([ -])", "(?P<gap>[ -])"))
_IBAN = re.compile(_KINDS["iban"])
#: What every match of any kind contains; a text without it has none.
_NEEDED = re.compile(r"[@\d=:]|(?i:bearer)|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|eyJ")
#: Country calling codes of one and of two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


@lru_cache(maxsize=1)
def _random_key() -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key in KEY_SETTING, or where that is unset one drawn at random for this application, whose pseudonyms nobody can reverse or link later."""
    text = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING, None)
    return hashlib.blake2b(text.encode(), digest_size=32).digest() if text else _random_key()


def permute(x: int, n: int, tweak: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next square, walked until it is within n."""
    if n < 2:
        return x
    side = math.isqrt(n - 1) + 1
    width = (side.bit_length() + 7) // 8
    label = f"{tweak}/{n}/".encode()
    while True:
        left, right = divmod(x, side)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            half = left if back else right
            f = int.from_bytes(hashlib.blake2b(label + bytes([r]) + half.to_bytes(width, "big"), key=key, digest_size=width + 8).digest(), "big")
            left, right = ((right - f) % side, left) if back else (right, (left + f) % side)
        x = left * side + right
        if x < n:
            return x


_LATIN = "".join(c for c in map(chr, range(0xDF, 0x100)) if c != "\xf7")
_LATIN_UPPER = "".join(c for c in map(chr, range(0xC0, 0xDF)) if c != "\xd7")


def _in_alphabet(text: str, tweak: str, key: bytes) -> str:
    """Permute the letters (ASCII and Latin-1, by case) and digits of a text within their kinds; other characters stay."""
    out = list(text)
    for name, alphabet in (("d", string.digits), ("l", string.ascii_lowercase), ("u", string.ascii_uppercase), ("m", _LATIN), ("n", _LATIN_UPPER)):
        at = [k for k, c in enumerate(text) if c in alphabet]
        if at:
            x = 0
            for k in at:
                x = x * len(alphabet) + alphabet.index(text[k])
            x = permute(x, len(alphabet) ** len(at), f"{tweak}{name}", key)
            for k in reversed(at):
                x, d = divmod(x, len(alphabet))
                out[k] = alphabet[d]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that a number without one needs."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _refill(layout: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def _number(digits: str, tweak: str, key: bytes) -> str:
    return str(permute(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}", key)).zfill(len(digits)) if digits else ""


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it doesn't validate."""
    digits = "".join(c for c in value if c in string.digits)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{_in_alphabet(local, 'email', key)}@{domain}"
    if kind == "secret":
        cut = re.search(r"[A-Za-z0-9._~\-+/]+\Z", value).start()
        cut = max(cut, re.match(r"(?i:bearer\s+)|.*?[=:]\s*[\"']?", value).end())
        body = value[cut:]
        if re.fullmatch("[0-9a-f]+", body):
            return value[:cut] + f"{permute(int(body, 16), 16 ** len(body), 'hex', key):0{len(body)}x}"
        return value[:cut] + _in_alphabet(body, "secret", key)
    if kind == "key":
        head = re.match(r"eyJ|github_pat_|glpat-|xox.-|gh._|.{4}", value).group()
        return head + _in_alphabet(value[len(head) :], "key", key)
    if kind == "ip6":
        if "::" in value and not digits:  # as in program text
            return None
        try:
            x = int(ipaddress.IPv6Address(value))
        except ValueError:
            return None
        return str(ipaddress.IPv6Address(permute(x, 1 << 128, "ip6", key)))
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", key)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        iso = value[4:5] == "-"
        slash = "-" if iso else value.lstrip(string.digits)[0]
        y, m, d = value.split("-") if iso else reversed(value.split(slash))
        short = min(len(m), len(d)) < 2
        swap = not iso and int(m) > 12
        if swap:
            m, d = d, m
        try:
            x = datetime.date(int(y), int(m), int(d)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= x < _DAYS:
            return None
        t = datetime.date.fromordinal(_FIRST_DAY + permute(x, _DAYS, "date", key))
        month, day = (f"{x:0{1 if short else 2}}" for x in (t.month, t.day))
        return t.isoformat() if iso else slash.join([*((month, day) if swap else (day, month)), str(t.year)])
    if kind == "ssn":
        if not _ssn_ok(digits):
            return None
        digits = _number(digits, "ssn", key)
        while not _ssn_ok(digits):  # walk the cycle back to a valid number
            digits = _number(digits, "ssn", key)
        return _refill(value, digits)
    if kind == "phone":
        if not 7 <= len(digits) <= 15:
            return None
        code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3]) if value[0] == "+" else ""
        return _refill(value, code + _number(digits[len(code) :], "phone", key))
    if kind == "iban":
        bare = value.replace(" ", "")
        if not 15 <= len(bare) <= 34 or int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
            return None
        rest = _in_alphabet(bare[4:], "iban", key)
        it = iter(f"{bare[:2]}{_iban_check(bare[:2], rest):02}{rest}")
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "card":
        if str(luhn(digits[:-1])) != digits[-1] or len(set(digits)) == 1:
            return None
        body = _number(digits[:-1], "card", key)
        return _refill(value, body + str(luhn(body)))
    raise ValueError(kind)


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, first, end) of each in characters of the new text."""
    if not text or not _NEEDED.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    m = _ANY.search(text)
    while m:
        kind = next(k for k in _KINDS if m[k] is not None)
        end, new = m.end(), pseudonym(kind, m.group(), key)
        if new is None and kind == "iban":  # the match may have taken in the words behind: try its shorter prefixes
            for cut in range(m.end() - 1, m.start() + 11, -1):
                if not (text[cut].isalnum() or text[cut] == "_") and _IBAN.fullmatch(text, m.start(), cut) and (new := pseudonym(kind, text[m.start() : cut], key)) is not None:
                    end = cut
                    break
        if new is not None:
            out += [text[at : m.start()], new]
            size += m.start() - at
            spans.append((kind, size, size + len(new)))
            size += len(new)
            at = end
        m = _ANY.search(text, m.start() + 1 if new is None and kind == "iban" else end)
    return "".join([*out, text[at:]]), spans


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text, and `pii`: (kind, first, end) of each, in place of a column of that name.

    Null and empty texts stay as they are, with an empty list; equal values get equal pseudonyms
    in all rows, repeated ones included; an empty table stays empty. All other columns pass unchanged.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.drop("pii")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col):
            done = [replace(t, key) for t in batch.column(at).to_pylist()]
            cols = [*batch.columns, pa.array([[dict(zip(("kind", "first", "end"), s)) for s in x] for _, x in done], _ARROW)]
            cols[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "pii"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii", _SPANS)]))
