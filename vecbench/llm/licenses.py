"""Licence scans (operator 11).

One Aho-Corasick automaton over a text's words finds notice phrases and identifier tags (SPDX headers, the
licence fields of package files). What follows a tag is read as a licence expression: a shunting-yard
parser brings it into postfix order (with before and before or), which is then evaluated for its licences,
its canonical text and whether a policy allows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import binary, ship

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notice phrases, their labels and how sure they are.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "licensed under the apache license": ("apache", 0.95),
    "released under the mit license": ("mit", 0.95),
    "licensed under the mit license": ("mit", 0.95),
    "licensed under the gnu general public license": ("gpl", 0.95),
    "under the terms of the gnu general public license": ("gpl", 0.95),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu library general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "boost software license": ("bsl", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "creative commons zero": ("cc0", 0.9),
    "cc0 1 0": ("cc0", 0.8),
    "cc by": ("cc-by", 0.6),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.8),
    "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "gnu free documentation license": ("gfdl", 0.9),
}
BASE_WEIGHT, TAG_WEIGHT = 0.7, 0.98

#: Words of the tags that an expression follows.
TAGS = ("spdx license identifier", "license expression", "license", "licence")

#: Licence identifiers (without version suffixes -only and -or-later) and their labels.
LICENSES = {
    "0bsd": "bsd", "agpl-3.0": "agpl", "apache-1.1": "apache", "apache-2.0": "apache", "artistic-2.0": "artistic",
    "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "bsd-4-clause": "bsd", "bsl-1.0": "bsl", "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by",
    "cc-by-sa-3.0": "cc-by-sa", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd", "cc0-1.0": "cc0", "cddl-1.0": "cddl", "epl-1.0": "epl",
    "epl-2.0": "epl", "gfdl-1.3": "gfdl", "gpl-2.0": "gpl", "gpl-3.0": "gpl", "isc": "isc", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl",
    "mit": "mit", "mit-0": "mit", "mpl-1.1": "mpl", "mpl-2.0": "mpl", "ms-pl": "ms-pl", "ofl-1.1": "ofl", "openssl": "openssl",
    "python-2.0": "python", "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib",
}
#: Exceptions that may stand behind "with".
EXCEPTIONS = {
    "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-3.1",
    "libtool-exception", "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception-1.0",
}
#: Labels that the default policy allows, and exceptions that make any licence allowed.
PERMISSIVE = frozenset({"apache", "artistic", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "ofl", "python", "unlicense", "wtfpl", "zlib"})
LINKABLE = frozenset({"classpath-exception-2.0", "gcc-exception-3.1", "linux-syscall-note"})

#: Bytes between words become spaces: 00-2F, 3A-40, 5B-60 and 7B-7F; A-Z become a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_IN_WORD = np.array([chr(c) != " " for c in _WORDS])
#: A longer run than this is no identifier: it is cut there, and so unknown.
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.:-]{0,199}\+?)")
#: Between a tag and its expression: quotes, a colon or an equals sign.
_AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?[ \t]*(?=[A-Za-z0-9(])")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Tokens of an expression at most; a longer one is reported as an error.
MAX_TOKENS = 400


class ExpressionError(ValueError):
    pass


def tokens_of(text: bytes, at: int = 0) -> list[str]:
    """Tokens from byte ``at`` of ``text``, as long as operands, operators and brackets may follow each other on a line."""
    out, depth, operand = [], 0, False
    while m := _TOKEN.match(text, at):
        token = m[1].decode("ascii")
        if token == "(":
            if operand:
                break
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif token.lower() in PRECEDENCE:
            if not operand:
                break
            operand = False
        elif operand:
            break
        else:
            operand = True
        if len(out) == MAX_TOKENS:
            raise ExpressionError("too long")
        out.append(token)
        at = m.end()
    return out


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: operands, and operators (lower case) behind theirs; "with" binds most, then "and"."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        op = token.lower()
        if op in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[op]:
                out.append(held.pop())
            held.append(op)
        elif token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ExpressionError("a bracket is closed that was not opened")
            held.pop()
        else:
            out.append(token)
    while held:
        op = held.pop()
        if op == "(":
            raise ExpressionError("a bracket is not closed")
        out.append(op)
    return out


@dataclass(frozen=True)
class Evaluated:
    """Canonical text, rank of its last operator, labels, whether every identifier is known, verdict of the policy."""

    text: str
    rank: int
    labels: frozenset[str]
    known: bool
    allowed: bool


def _operand(token: str, allowed: frozenset[str]) -> Evaluated:
    name = token.lower()
    bare = re.sub(r"(-only|-or-later|\+)$", "", name)
    label = LICENSES.get(bare)
    own = name.startswith(("licenseref-", "documentref-"))
    return Evaluated(name, 4, frozenset([label] if label else ["custom"] if own else []), label is not None or own, label in allowed)


def evaluate(expression: list[str], allowed: frozenset[str] = PERMISSIVE) -> Evaluated:
    """Value of a postfix expression. "or" is allowed if a side is, "and" if both are; "with" if the licence is or
    the exception permits linking."""
    stack: list = []
    for token in expression:
        if token not in PRECEDENCE:
            stack.append(token)
            continue
        if len(stack) < 2:
            raise ExpressionError(f"{token} lacks a side")
        b, a = stack.pop(), stack.pop()
        a = _operand(a, allowed) if isinstance(a, str) else a
        if token == "with":
            if not isinstance(b, str) or a.rank != 4:
                raise ExpressionError("with takes a licence and an exception")
            b = b.lower()
            stack.append(Evaluated(f"{a.text} with {b}", 3, a.labels, a.known and b in EXCEPTIONS, a.allowed or b in LINKABLE))
            continue
        b = _operand(b, allowed) if isinstance(b, str) else b
        rank = PRECEDENCE[token]
        text = f" {token} ".join(f"({x.text})" if x.rank < rank else x.text for x in (a, b))
        verdict = a.allowed or b.allowed if token == "or" else a.allowed and b.allowed
        stack.append(Evaluated(text, rank, a.labels | b.labels, a.known and b.known, verdict))
    if len(stack) != 1:
        raise ExpressionError("no single expression")
    return _operand(stack[0], allowed) if isinstance(stack[0], str) else stack[0]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
        for phrase in phrases:
            key = f" {phrase} "
            found.add_word(key, [*found.get(key, []), (kind, phrase, phrase.count(" ") + 1, len(key))])
    found.make_automaton()
    return found


def expression_at(text: bytes, at: int, allowed: frozenset[str]) -> tuple[str, Evaluated | None, str] | None:
    """(source, value or None, error) of the expression behind a tag that ends at byte ``at``; None: no expression there."""
    start = _AFTER_TAG.match(text, at)
    if not start:
        return None
    source = ""
    try:
        tokens = tokens_of(text, start.end())
        source = " ".join(tokens)
        value = evaluate(postfix(tokens), allowed)
    except ExpressionError as e:
        return source, None, str(e)
    return (source, value, "") if value.known else (source, None, "unknown identifier")


def scan(text: bytes, allowed: frozenset[str] = PERMISSIVE) -> dict:
    """Everything found in a text; see ``license_scan``."""
    words = text.translate(_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    places, notices, expressions, seen, at = [], [], [], 0, 0
    starts = ends = None
    evidence: dict[tuple[str, str], float] = {}
    for last, found in _automaton().iter(line):
        seen += line.count(" ", at, last)  # words before the one that ends here, and that one
        at = last
        for kind, phrase, width, _ in found:
            first = seen - width
            if kind == "base":
                places.append((first, BASE[phrase]))
                evidence["base", BASE[phrase]] = BASE_WEIGHT
            elif kind == "notice":
                label, weight = NOTICES[phrase]
                notices.append((first, -width, label, weight, phrase))
            else:
                if ends is None:
                    inside = np.concatenate([[False], _IN_WORD[np.frombuffer(text, np.uint8)], [False]])
                    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
                got = expression_at(text, int(ends[first + width - 1]), allowed)
                plain = phrase in ("license", "licence")  # words of prose too: only a known expression counts
                if got and (got[1] or not plain):
                    source, value, error = got
                    expressions.append({"source": source, "canonical": value and value.text, "labels": sorted(value.labels) if value else [],
                                        "allowed": value and value.allowed, "error": error, "first_word": first, "last_word": first + width - 1,
                                        "byte": int(starts[first])})
                    for label in value.labels if value else ():
                        evidence["tag", label] = TAG_WEIGHT
    longest, end = [], -1
    for first, width, label, weight, phrase in sorted(notices):  # one inside another is part of it
        if first - width > end:
            end = first - width
            longest.append({"label": label, "phrase": phrase, "first_word": first, "last_word": end - 1})
            evidence["notice", label] = max(weight, evidence.get(("notice", label), 0))
    doubt = 1.0
    for key in sorted(evidence):
        doubt *= 1 - evidence[key]
    base = sorted({label for _, label in places})
    verdicts = [x["allowed"] for x in expressions if x["allowed"] is not None]
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places)[0] if places else None,
            "last_word": max(places)[0] if places else None, "base_labels": ",".join(base),
            "labels": ",".join(sorted({label for _, label in evidence})), "score": round(1 - doubt, 9),
            "allowed": all(verdicts) if verdicts else None, "notices": longest, "expressions": expressions}


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "allowed boolean, notices array<struct<label: string, phrase: string, first_word: long, last_word: long>>, "
          "expressions array<struct<source: string, canonical: string, labels: array<string>, allowed: boolean, error: string, "
          "first_word: long, last_word: long, byte: long>>")
_NOTICE = pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])
_EXPRESSION = pa.struct([("source", pa.string()), ("canonical", pa.string()), ("labels", pa.list_(pa.string())), ("allowed", pa.bool_()),
                         ("error", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("byte", pa.int64())])
_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
          "labels": pa.string(), "score": pa.float64(), "allowed": pa.bool_(), "notices": pa.list_(_NOTICE), "expressions": pa.list_(_EXPRESSION)}


def license_scan(docs: DataFrame, allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """Per row of ``docs``: n_words, places of the base phrases (n_base, first_word, last_word, base_labels), all labels,
    score, ``allowed`` (whether the policy allows every valid expression; null without one), ``notices`` (label and
    words of each notice phrase) and ``expressions`` (source, canonical text, labels, verdict or error, place of the
    tag in words and bytes).

    score is 1 less the product of what each kind of evidence a label (base phrase 0.7, notice phrase 0.6 to 0.95,
    valid tag 0.98) leaves in doubt; 0 without any. Null text is empty: no words, no labels (empty strings), score 0.
    Rows answer for themselves, so repeated rows and null doc_ids get a row each; further columns are ignored; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                rows = [scan(text or b"", allowed) for text in binary(some.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *[pa.array([r[c] for r in rows], t) for c, t in _KINDS.items()]], ["doc_id", *_KINDS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
