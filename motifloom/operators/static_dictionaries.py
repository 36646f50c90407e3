"""Dictionaries known to both sides, so that only their name is sent."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from motifloom.config import Config

from . import domains
from .patterns import Token

MARK = ("<SD_", ">")

_POLICY = "def evaluate(self,;return False;return True;rule.user == user;rule.action == action;rule.resource == resource:;rule.effect == \"allow\":;rule.effect == \"deny\":"

#: phrases common in texts of a kind
PHRASES: dict[str, list[str]] = {
    "policy-python-v1": _POLICY.split(";"),
    "python-v1": ["if __name__ == \"__main__\":", "def __init__(self,", "raise ValueError(", "return None", "for i in", "import os", "from typing import", "is not None", "in range(", "except Exception as e:", "with open(", "not in"],
    "typescript-v1": ["export default", "export const", "import { }", "async function", "=> {", "return new", "=== null", "!== undefined", "try {", "} catch (error) {", "} else {"],
    "markdown-v1": ["| --- |", "- [ ]", "- [x]", "## Usage", "## Installation", "For example,", "as well as", "in order to"],
    "json-v1": ["\"id\": 1,", "\"type\": \"string\",", "\"type\": \"object\",", "\"name\": \"\",", "\"value\": null", "} , {", "] ,", "\"enabled\": true,"],
    "sql-v1": ["SELECT * FROM", "INSERT INTO", "CREATE TABLE IF NOT EXISTS", "PRIMARY KEY", "NOT NULL", "GROUP BY", "ORDER BY", "LEFT JOIN", "INNER JOIN", "IS NULL", "COUNT(*) AS"],
}
#: phrases of the other kinds with fewer than two tokens would save nothing
_ENTRIES: dict[str, dict[str, tuple[str, ...]]] = {k: {f"{MARK[0]}{i}{MARK[1]}": tuple(p.split()) for i, p in enumerate(v)} for k, v in PHRASES.items()}
_OF_DOMAIN = {"code-python": "policy-python-v1", "security-policy": "policy-python-v1"}


def names() -> list[str]:
    """Identifiers of all known dictionaries."""
    return sorted(_ENTRIES)


def is_known(identifier: str) -> bool:
    return identifier in _ENTRIES


def entries(identifier: str) -> dict[str, tuple[str, ...]]:
    """The dictionary of this name; ValueError if there is none."""
    if identifier not in _ENTRIES:
        raise ValueError(f"Unknown static dictionary: {identifier}")
    return dict(_ENTRIES[identifier])


def register(identifier: str, phrases: Sequence[Sequence[str]] | dict[str, Sequence[str]]) -> None:
    """Makes a dictionary known in this process; the marks are given in order."""
    listed = phrases.items() if isinstance(phrases, dict) else ((f"{MARK[0]}{i}{MARK[1]}", p) for i, p in enumerate(phrases))
    _ENTRIES[identifier] = {k: tuple(v) for k, v in listed}


def save(identifier: str, found: dict[str, Sequence[str]], path: str) -> None:
    """As one JSON object: identifier and entries."""
    Path(path).write_text(json.dumps({"identifier": identifier, "entries": {k: list(v) for k, v in found.items()}}, ensure_ascii=False))


def load(path: str) -> str:
    """Makes a saved dictionary known and gives its identifier."""
    held = json.loads(Path(path).read_text())
    register(held["identifier"], held["entries"])
    return held["identifier"]


def table(spark: SparkSession) -> DataFrame:
    """(identifier, ord, meta, phrase) of all known dictionaries: some dozens of rows."""
    rows = [(k, i, m, " ".join(p)) for k, v in sorted(_ENTRIES.items()) for i, (m, p) in enumerate(v.items())]
    return spark.createDataFrame(rows, "identifier string, ord int, meta string, phrase string")


def chosen(tokens: Sequence[Token], config: Config) -> str | None:
    """The configured dictionary, or that of the detected domain if it is sure enough."""
    if config.static_id is not None:
        entries(config.static_id)
        return config.static_id
    if config.static_auto:
        domain, confidence = domains.detected(tokens)
        if confidence >= config.static_confidence:
            return _OF_DOMAIN.get(domain or "")
    return None


def applied(tokens: Sequence[Token], identifier: str) -> list[Token]:
    """The tokens with every phrase replaced by its mark: longer phrases first, left to right."""
    phrases = sorted(((p, m) for m, p in entries(identifier).items() if len(p) > 1), key=lambda x: -len(x[0]))
    starts: dict[Token, list[int]] = {}
    for i, t in enumerate(tokens):
        starts.setdefault(t, []).append(i)
    taken, mark_at = bytearray(len(tokens)), {}
    for phrase, mark in phrases:
        n = len(phrase)
        for i in starts.get(phrase[0], ()):
            if tuple(tokens[i : i + n]) == phrase and not taken.count(1, i, i + n):
                taken[i : i + n] = b"\x01" * n
                mark_at[i] = (mark, n)
    out: list[Token] = []
    at = 0
    while at < len(tokens):
        mark, n = mark_at.get(at, (tokens[at], 1))
        out.append(mark)
        at += n
    return out
