"""Secret scans: keyword automaton, anchored expressions, embedded checksums.

An Aho-Corasick automaton over a few dozen short literals passes once over the
whole text, and one over the keywords that stand in any case passes over an
ASCII-lower-cased copy.  Only where a literal ends is that rule's expression tried,
anchored at the literal's start, and what it matches is then validated by the
checksum that the secret itself carries (Luhn, CRC-32 in base 62, base-58
double SHA-256, ISO 7064 mod 97, DER length, JSON header), or, for kinds that
have none, by entropy.

The time is linear in the text.  Where an expression can run on over further
literals of its own rule (``RUNS``), the end of such a run is found once: a
Slack token is tried once a run, from its first literal, and a web token's
segments behind the run are read once for all the heads that may begin in it,
which have ``MAX_HEAD`` characters at most.  All other expressions are bounded
or stop before the next literal.

Defined results: null or empty text has no secrets; a null ``doc_id`` stays
null in the findings; repeated rows are scanned each; payment cards begin with
the digits of an issuer; passwords are found from 6 characters, without spaces
and with a digit or sign; of findings that overlap, the one that starts first
stays, then the longer, then the one whose rule is listed first.  All other columns are left alone, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MIN_ENTROPY = 2.5  #: bits a character, for kinds without a checksum


def luhn(text: str) -> bool:
    """Whether the digits in ``text`` pass the Luhn test."""
    digits = [int(c) for c in reversed(text) if c in "0123456789"]
    return len(set(digits)) > 1 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def crc62(token: str) -> bool:
    """Prefix, 30 characters, then the CRC-32 of those 30 as 6 base-62 digits."""
    body, check = token[4:-6], token[-6:]
    value, out = binascii.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = _B62[digit] + out
    return out.rjust(6, "0") == check


def base58check(text: str) -> bool:
    """Version byte, payload and 4 bytes of double SHA-256."""
    value = 0
    for c in text:
        value = value * 58 + _B58.index(c)
    raw = value.to_bytes(max(5, (value.bit_length() + 7) // 8), "big")
    return raw[0] == 0x80 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def mod97(text: str) -> bool:
    """ISO 13616 account numbers."""
    s = re.sub(r"\s", "", text).upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def jwt(text: str) -> bool:
    """The first segment is a JSON object that names an algorithm."""
    head = text.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def pem(text: str) -> bool:
    """The body is base 64, and DER's own length (or OpenSSH's magic) fits it."""
    try:
        raw = base64.b64decode(re.sub(r"-----[^-]+-----|\s", "", text), validate=True)
    except ValueError:
        return False
    if raw[:1] != b"\x30" or len(raw) < 4:
        return raw.startswith(b"openssh-key-v1\0")
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    k = raw[1] & 0x7F
    return len(raw) == 2 + k + int.from_bytes(raw[2 : 2 + k], "big")


def entropy(text: str) -> bool:
    """Mixed and irregular enough for a random key."""
    return any(c.isdigit() for c in text) and _bits(text) >= MIN_ENTROPY


def _bits(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text.lower()).values())


def password(text: str) -> bool:
    """Irregular, and with a digit or a sign inside that plain words don't have."""
    return any(c.isdigit() or c in "!#$%&*?@^~" for c in text.rstrip("!?")) and _bits(text) >= MIN_ENTROPY


#: kind, literals, expression anchored at the literal (the group that matches, if any, is the secret), validation, its name
RULES: list[tuple[str, list[str], str, Callable[[str], bool], str]] = [
    ("payment_card", [f"{i:02d}" for i in (*range(22, 28), 30, *range(34, 70))], r"(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![0-9A-Za-z])", luhn, "luhn"),
    ("github_token", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", crc62, "crc32"),
    ("npm_token", ["npm_"], r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])", crc62, "crc32"),
    ("wif_key", ["5H", "5J", "5K"], r"5[HJK][1-9A-HJ-NP-Za-km-z]{49}(?![0-9A-Za-z])", base58check, "sha256d"),
    ("iban", ["iban"], r"(?i:iban)[^\w\n]{1,4}([A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])", mod97, "mod97"),
    ("jwt", ["eyJ"], r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{16,}", jwt, "json"),
    ("private_key", ["-----BEGIN "], r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END \1PRIVATE KEY-----", pem, "der"),
    ("aws_key_id", ["AKIA", "ASIA"], r"A[KS]IA[A-Z2-7]{16}(?![0-9A-Za-z])", entropy, "none"),
    ("google_key", ["AIza"], r"AIza[\w-]{35}(?![\w-])", entropy, "none"),
    ("slack_token", ["xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"], r"xox[abprs]-[0-9A-Za-z-]{20,}", entropy, "none"),
    ("stripe_key", ["sk_live_", "rk_live_"], r"[sr]k_live_[0-9A-Za-z]{16,}", entropy, "none"),
    (
        "assigned_token",
        ["token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key"],
        r"(?i:token|secret|password|passwd|api[_-]?key|access_key)[\w-]{0,16}[^\w\n=:]{0,8}[=:][^\w\n]{0,8}([0-9A-Za-z+/_-]{20,}={0,2})(?![0-9A-Za-z])",
        entropy,
        "none",
    ),
    (
        "assigned_password",
        ["password", "passwd"],
        r"(?i:password|passwd)[\w-]{0,16}[^\w\n=:]{0,8}[=:]{1,3}>?[ \t]{0,8}"
        r"(?![\"'`]?(?:\$[{(]|\$[A-Z_][A-Z0-9_]*(?![^\s\"'`])|%\(|\w+://))"  # variables and addresses
        r"(?:\"([^\s\"]{6,128})\"|'([^\s']{6,128})'|`([^\s`]{6,128})`|([^\s\"'`()<>\[\]{},;]{6,128})(?<![.:])(?![^\s\"'`)>\]},;.:]))",
        password,
        "none",
    ),
]
_SHORTEST_IBAN = 15
MAX_HEAD = 2048  #: characters of a web token's first segment
#: characters over which an expression runs on, literals of the rule among them
RUNS = {"slack_token": re.compile(r"[0-9A-Za-z-]+"), "jwt": re.compile(r"[\w-]+", re.ASCII)}
_BEHIND = re.compile(r"\.[\w-]{8,}\.[\w-]{16,}", re.ASCII)  # a web token's other segments
_ANY_CASE = {"iban", "assigned_token", "assigned_password"}  # literals in lower case, looked for in any
_WHOLE = {"private_key", "payment_card"}  # their groups are not the secret
_RANK = {r[0]: i for i, r in enumerate(RULES)}
_ANCHORED = {i for i, r in enumerate(RULES) if r[0] not in ("private_key", "assigned_token", "assigned_password")}


def _ends(text: str, kind: str, start: int, end: int) -> Iterator[int]:
    """Where a match may end, the last first: an IBAN also before each of its spaces, as the words after it look like more groups."""
    yield end
    while kind == "iban" and (end := text.rfind(" ", start, end)) >= 0 and end - start - text.count(" ", start, end) >= _SHORTEST_IBAN:
        yield end


class Scanner:
    """The automaton and the expressions; one a Python worker."""

    def __init__(self) -> None:
        self.patterns = [re.compile(r[2], re.ASCII) for r in RULES]
        self.exact, self.lower = ahocorasick.Automaton(), ahocorasick.Automaton()
        for automaton, any_case in ((self.exact, False), (self.lower, True)):
            rules: dict[str, list[int]] = {}
            for i, (kind, literals, *_rest) in enumerate(RULES):
                for literal in literals if (kind in _ANY_CASE) == any_case else ():
                    rules.setdefault(literal, []).append(i)
            for literal, those in rules.items():
                automaton.add_word(literal, (those, len(literal)))
            automaton.make_automaton()

    def _literals(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, rule) of each literal in ``text``."""
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII alone, so offsets stay
        for automaton, where in ((self.exact, text), (self.lower, lowered)):
            for at, (those, n) in automaton.iter(where):
                for i in those:
                    yield at - n + 1, i

    def scan(self, text: str | None) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, checksum) in characters, without overlaps."""
        found: list[tuple[int, int, str, str]] = []
        ends: dict[str, int] = {}  # by kind: the end of the run that was entered last
        behind = 0  # the end of the web token whose head ends there, or 0
        for start, i in self._literals(text or ""):
            if i in _ANCHORED and start and text[start - 1].isalnum():
                continue
            kind, _, _, valid, checksum = RULES[i]
            if kind in RUNS:
                fresh = start >= ends.get(kind, 0)
                if fresh:
                    ends[kind] = RUNS[kind].match(text, start).end()
                if kind == "jwt":
                    if fresh:
                        behind = m.end() if (m := _BEHIND.match(text, ends[kind])) else 0
                    if behind and 11 <= ends[kind] - start <= MAX_HEAD and valid(text[start : ends[kind]]):
                        found.append((start, behind, kind, checksum))
                    continue
                if not fresh:
                    continue
            m = self.patterns[i].match(text, start)
            if not m:
                continue
            group = 0 if kind in _WHOLE else m.lastindex or 0
            first = m.start(group)
            for end in _ends(text, kind, *m.span(group)):
                if valid(text[first:end]):
                    found.append((first, end, kind, checksum))
                    break
        if len(found) > 1:
            found.sort(key=lambda f: (f[0], -f[1], _RANK[f[2]]))
            kept = found[:1]
            for f in found[1:]:
                if f[0] >= kept[-1][1]:
                    kept.append(f)
            found = kept
        return found


def redacted(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text with each finding replaced by its kind."""
    out, at = [], 0
    for start, end, kind, _ in found:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


_FOUND = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("checksum", pa.string()), ("secret_sha256", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """All secrets of ``docs`` (doc_id, text): one row a finding, with offsets in characters and a fingerprint instead of the secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                for start, end, kind, checksum in scanner.scan(text):
                    rows.append((doc_id, kind, start, end, checksum, hashlib.sha256(text[start:end].encode("utf-8", "surrogatepass")).hexdigest()))
            if rows:
                yield common.record(_FOUND, *map(list, zip(*rows)))

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, kind string, start bigint, end bigint, checksum string, secret_sha256 string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]`` and ``n_chars``, where there is such a column, brought up to date; no row goes."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            k = batch.schema.get_field_index("text")
            changed: dict[int, str] = {}
            for i, value in enumerate(batch.column(k)):
                text = value.as_py()
                if found := scanner.scan(text):
                    changed[i] = redacted(text, found)
            if not changed:
                yield batch
                continue
            columns = list(batch.columns)
            texts = columns[k].to_pylist()
            for i, text in changed.items():
                texts[i] = text
            columns[k] = pa.array(texts, type=columns[k].type)
            if "n_chars" in names:
                j = batch.schema.get_field_index("n_chars")
                counts = columns[j].to_pylist()
                for i, text in changed.items():
                    counts[i] = len(text)
                columns[j] = pa.array(counts, type=columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in the documents."""
    return scan(common.table(spark, sf_dir, "documents"))
