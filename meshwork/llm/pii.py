"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the characters and words that personal data
cannot do without: at-signs, digits and plus signs, URL schemes, and cues such
as "iban", the latter two in any mix of upper and lower case. At each anchor a local parser expands to the boundaries of an
address, number or account and validates it; text far from anchors is never
parsed.

Kinds, in the order in which spans are listed:

- email, ip, card, phone: the base kinds, leftmost and non-overlapping each;
- url: a scheme and what follows it up to white space or a closing mark;
- iban: a cue, then a country code, two check digits and up to 30 characters
  whose remainder modulo 97 is 1; what follows an account is cut off at its
  country's length, or at the end of a word where the country is not known;
- ssn: a cue, then three groups of 3, 2 and 4 digits;
- secret: a cue such as "token" or "password", a colon, equals sign or quote,
  then a value with digits that is no plain word; keys whose first letters tell
  their issuer, signed tokens of three parts, and whole private key blocks;
- passport, tax: a cue that is a word of its own, then a number of that form;
- address: a street's name and kind with its house number, and the city and
  postal code after it, if any.

Defined results: null and empty texts have no spans; offsets count code points,
ends exclusive; repeated rows get equal results; an empty table gives no rows.
Texts of any length are searched whole, and no part of one is parsed again and again:
a run that a parser has passed over once is not entered by another cue of its kind.
Where two cues lead to one span, it is listed once. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn", "secret", "passport", "tax", "address")
SCHEMES = ("http://", "https://", "ftp://", "www.")
#: Anchors in lower case; what stands under a kind leads to that kind's parser.
CUES = {
    "iban": ("iban", "account", "konto"),
    "ssn": ("ssn", "social security"),
    "named secret": ("token", "secret", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "accesskey", "bearer"),
    "password": ("password", "passwd", "passphrase", "pwd", "passwort", "mot de passe"),
    "issued key": ("akia", "asia", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "aiza", "eyj"),
    "key block": ("private key-----",),
    "passport": ("passport", "reisepass", "pasaporte", "passeport"),
    "tax": ("tax id", "tax number", "tax no", "taxpayer", "employer identification", "vat", "steuernummer", "steuer-id"),
    "address": (" street", " st", " avenue", " ave", " road", " rd", " boulevard", " blvd", " lane", " drive", " court", " square"),
    "street": ("straße", "strasse"),
}
#: How far behind a cue its account may begin.
CUE_REACH = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:(?:https?|ftp)://|www\.)[^\s<>\"'`{}|\\^]+", re.IGNORECASE)
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9])")
#: Characters of an account by its country.
_IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: What stands between a cue and its secret; a name may go on, as in token_id or secretKey.
_GIVEN = r"[\"']?[A-Za-z_-]{0,12}[\"'\])]{0,2}\s{0,3}(?:[:=]{1,2}>?|=>)\s{0,3}[\"'`]?"
_NAMED_SECRET = re.compile(rf"(?:{_GIVEN}(?:Bearer )?|(?<=[Bb]earer) )([A-Za-z0-9_+/.~-]{{16,}})={{0,2}}")
_PASSWORD = re.compile(rf"{_GIVEN}([^\s\"'`<>]{{6,}})")
_KEY_RUN = re.compile(r"[A-Za-z0-9_.-]+")
#: Forms of keys that name their issuer, and of signed tokens.
_ISSUED_KEY = re.compile(
    r"A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pos]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|xox[bp]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
)
_KEY_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]{0,20}\Z")
#: Header lines, lines of the key, and the closing line if there is one.
_KEY_BODY = re.compile(
    r"(?:\s{0,2}[A-Za-z-]{1,30}: [^\n]{0,200}(?=\n))*+(?:\s{0,4}[A-Za-z0-9+/=]{16,}+(?=\s|-|\Z))*+(?:\s{0,4}[A-Za-z0-9+/=]{0,80}\s{0,4}-----END [A-Z0-9 ]{1,30}-----)?"
)
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{1,2}[0-9]{6,8}|[0-9]{8,9}|[A-Z][0-9A-Z]{8}(?<=[0-9]))(?![A-Za-z0-9])")
_TAX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{2}-[0-9]{7}|[A-Z]{2} ?[0-9]{8,12}|[0-9]{2,3}/[0-9]{3}/[0-9]{4,5}|[0-9]{9,13})(?![A-Za-z0-9])")
_STREET_HEAD = re.compile(r"(?<![\w.,-])[0-9]{1,6}[A-Za-z]?\s(?:(?:[A-Z][\w'.-]*|[0-9]{1,3}(?:st|nd|rd|th))\s){0,3}(?:[A-Z][\w'.-]*|[0-9]{1,3}(?:st|nd|rd|th))\Z")
_STREET_TAIL = re.compile(
    r"\.?(?:,?\s(?:Apt|Apartment|Suite|Unit)\.?\s?#?[0-9]{1,5}[A-Za-z]?)?(?:,\s[A-Z][A-Za-z'-]{1,20}(?:\s[A-Z][A-Za-z'-]{1,20}){0,2},?\s[A-Z]{2}\s[0-9]{5}(?:-[0-9]{4})?(?![0-9]))?"
)
_NUMBER_TAIL = re.compile(r"\s[0-9]{1,4}[a-z]?(?![0-9A-Za-z])(?:,\s(?:D-)?[0-9]{5}\s\w[\w-]{1,30})?")
#: Bits of each character, at least, of a value behind a cue; English words have about as many, but no digits.
LEAST_ENTROPY = 2.5
#: How far before a street's kind its house number, or its name, may begin.
STREET_REACH = 60
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"


def _automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, for texts lowered by ``ascii_lower``."""
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in _DIGITS), *((s, "url") for s in SCHEMES)]:
        found.add_word(word, (kind, len(word)))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def ascii_lower(text: str) -> str:
    """``text`` with A to Z in lower case; offsets stay, which str.lower does not promise."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _iban(text: str, start: int, stop: int) -> tuple[int, int] | None:
    """The first account that begins from ``start`` to ``stop``."""
    for begin in _IBAN_START.finditer(text, start, stop + 4):
        m = _IBAN.match(text, begin.start())
        if not m:
            continue
        ends = [k + 1 for k in range(m.start(), m.end()) if text[k] != " "]
        size = _IBAN_SIZES.get(m[0][:2])
        if size is None:
            # whole words, most of them first
            tried = [e for e in reversed(ends) if e == m.end() or not text[e].isalnum()]
        else:
            tried = [*ends[size - 1 : size], m.end()]
        for end in tried:
            if iban_valid(text[m.start() : end]):
                return m.start(), end
    return None


def _email(text: str, at: int, last: int) -> tuple[int, int] | None:
    start = at
    while start > last and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def entropy(value: str) -> float:
    """Bits of a character, by the frequencies within ``value``."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


#: A parser takes a text, the places where a cue begins and ends, and the place up to which its kind is
#: settled; it returns the span, if any, and the place up to which its kind is settled then.
Parser = Callable[[str, int, int, int], tuple[tuple[int, int] | None, int]]


def _account(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
    span = _iban(text, max(end, last), end + CUE_REACH)
    return span, span[1] if span else last


def _ssn(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
    m = _SSN.search(text, end, end + CUE_REACH + 50)
    if m and last <= m.start() <= end + CUE_REACH:
        return m.span(), m.end()
    return None, last


def _named_secret(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
    m = _NAMED_SECRET.match(text, end) if end >= last else None
    if not m:
        return None, last
    value = m[1].rstrip(".")
    sure = any(c in _DIGITS for c in value) and entropy(value) >= LEAST_ENTROPY
    return ((m.start(1), m.end() if value == m[1] else m.start(1) + len(value)) if sure else None), m.end(1)


def _password(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
    m = _PASSWORD.match(text, end) if end >= last else None
    if not m:
        return None, last
    value = m[1].rstrip(".,;:)]}")
    sure = len(value) >= 6 and len(set(value)) >= 4 and any(c in _DIGITS for c in value)
    return ((m.start(1), m.start(1) + len(value)) if sure else None), m.end(1)


def _issued_key(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
    if start < last or start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
        return None, last
    run = _KEY_RUN.match(text, start)
    m = _ISSUED_KEY.match(text, start, run.end())
    return (m.span() if m and any(c in _DIGITS for c in m[0]) else None), run.end()


def _key_block(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
    head = _KEY_HEAD.search(text, max(last, start - 40), start) if start >= last else None
    if not head or text[start:end] != "PRIVATE KEY-----":
        return None, last
    stop = _KEY_BODY.match(text, end).end()
    return (head.start(), stop), stop


def _numbered(pattern: re.Pattern) -> Parser:
    def parse(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
        if start and text[start - 1].isalpha() or text[end : end + 1].isalpha():
            return None, last
        m = pattern.search(text, max(end, last), end + CUE_REACH + 16)
        if m and m.start() <= end + CUE_REACH:
            return m.span(), m.end()
        return None, last

    return parse


def _address(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
    if start < last or not text[start + 1 : start + 2].isupper() or text[end : end + 1].isalnum():
        return None, last
    head = _STREET_HEAD.search(text, max(last, start - STREET_REACH), start)
    if not head:
        return None, last
    stop = _STREET_TAIL.match(text, end).end()
    if text[stop - 1] == "." and not text[start + 1 : end].lower() in ("st", "ave", "rd", "blvd"):
        stop -= stop == end + 1  # the full stop of a sentence
    return (head.start(), stop), stop


def _street(text: str, start: int, end: int, last: int) -> tuple[tuple[int, int] | None, int]:
    number = _NUMBER_TAIL.match(text, end) if start >= last else None
    if not number:
        return None, last
    begin, least = start, max(last, start - STREET_REACH)
    while begin > least and (text[begin - 1].isalpha() or text[begin - 1] in ".-"):
        begin -= 1
    while begin < start and not text[begin].isupper():
        begin += 1
    return ((begin, number.end()), number.end()) if text[begin].isupper() else (None, last)


#: What a cue's kind leads to: the kind of the span, and its parser.
PARSERS: dict[str, tuple[str, Parser]] = {
    "iban": ("iban", _account),
    "ssn": ("ssn", _ssn),
    "named secret": ("secret", _named_secret),
    "password": ("secret", _password),
    "issued key": ("secret", _issued_key),
    "key block": ("secret", _key_block),
    "passport": ("passport", _numbered(_PASSPORT)),
    "tax": ("tax", _numbered(_TAX)),
    "address": ("address", _address),
    "street": ("address", _street),
}


#: Kinds that several parsers find, each on its own.
MERGED_KINDS = ("secret", "address")


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order, with spans that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    last, settled = dict.fromkeys(KINDS, 0), dict.fromkeys(CUES, 0)
    digit_before = -2
    for end, (kind, length) in automaton.iter(ascii_lower(text)):
        start = end - length + 1
        if kind == "0":
            in_run, digit_before = start == digit_before + 1, start
            if in_run:
                continue
            if start >= last["ip"] and (m := _IP.match(text, start)):
                last["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    found["ip"].append(m.span())
            if start >= last["card"] and (m := _CARD.match(text, start)):
                last["card"] = m.end()
                digits = re.sub("[^0-9]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif kind == "@":
            if start >= last["email"] and (span := _email(text, start, last["email"])):
                last["email"] = span[1]
                found["email"].append(span)
        elif kind == "+":
            if start >= last["phone"] and (m := _PHONE.match(text, start)):
                last["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            if start >= last["url"] and (m := _URL.match(text, start)):
                stop = start + len(m[0].rstrip(".,;:!?)]"))
                last["url"] = m.end()
                if stop > start + length:
                    found["url"].append((start, stop))
        else:
            named, parse = PARSERS[kind]
            span, settled[kind] = parse(text, start, end + 1, settled[kind])
            if span:
                found[named].append(span)
    for named in MERGED_KINDS:
        found[named] = _disjoint(found[named])
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans, of every row."""
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            digests, spans = [], []
            for text in batch.column(1).to_pylist():
                found = find_spans(text or "", automaton)
                for column, kind in zip(counts, BASE_KINDS):
                    column.append(len(found[kind]))
                digests.append(hashlib.sha256(listed(found, BASE_KINDS).encode()).hexdigest())
                spans.append(listed(found, KINDS))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; n_chars follows the text.

    Spans of different kinds that overlap are replaced together, under the kind
    that begins first. A null text stays null.
    """

    def replaced(text: str | None, automaton: ahocorasick.Automaton) -> str | None:
        if not text:
            return text
        found = find_spans(text, automaton)
        spans = sorted((a, b, k) for k in KINDS for a, b in found[k])
        parts, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                parts += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*parts, text[at:]]) if spans else text

    schema = docs.schema
    place = docs.columns.index("text")
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            texts = [replaced(t, automaton) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if counted:
                k = batch.schema.get_field_index("n_chars")
                sizes = [None if t is None else len(t) for t in texts]
                columns[k] = pa.array(sizes, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))
