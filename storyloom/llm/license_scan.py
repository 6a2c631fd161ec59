"""Licence scans: Aho-Corasick over words for notice phrases and tags, shunting-yard for licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases of the method.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license 2 0": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license": "mpl-2",
    "eclipse public license": "epl-2",
    "boost software license": "bsl-1",
    "isc license": "isc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "all rights reserved": "proprietary",
}
#: Tags that an expression follows, as words.
TAGS = ("spdx license identifier", "license expression")
#: Labels of identifiers (lower case, without a trailing ``-only``, ``-or-later`` or ``+``).
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "isc": "isc", "0bsd": "bsd", "bsl-1.0": "bsl-1",
    "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl-3", "mpl-2.0": "mpl-2", "epl-2.0": "epl-2",
    "cc0-1.0": "cc0", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc", "unlicense": "unlicense", "zlib": "zlib",
}
PERMISSIVE = {"mit", "apache-2", "bsd", "isc", "bsl-1", "cc0", "cc-by", "unlicense", "zlib"}
#: Exceptions under which a copyleft library may be linked freely.
FREE_EXCEPTIONS = {"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "linux-syscall-note"}
#: How much one label of each kind of evidence counts in the score.
WEIGHTS = {"base": 0.7, "notice": 0.5, "tag": 0.9}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_EXPRESSION = re.compile(r"(?:spdx-license-identifier|license-expression)[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.:+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, or None if it is malformed. Comment ends after it are ignored."""
    body = re.split(r"\*/|-->|#|//", expression)[0]
    if _TOKEN.sub("", body).strip(" \t\"',;."):
        return None
    out, stack, want_operand = [], [], True
    for token in _TOKEN.findall(body):
        word = token.lower().rstrip(".")
        if word in _RANK:
            if want_operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            want_operand = True
        elif word == "(":
            if not want_operand:
                return None
            stack.append(word)
        elif word == ")":
            if want_operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not want_operand:
                return None
            out.append(word)
            want_operand = False
    if want_operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """(labels, permissive): ``and`` needs both sides, ``or`` one; ``with`` frees copyleft by a linking exception."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left[0], left[1] or right[2] in FREE_EXCEPTIONS, ""))
            else:
                stack.append((left[0] | right[0], left[1] and right[1] if token == "and" else left[1] or right[1], ""))
        else:
            name = re.sub(r"(-only|-or-later|\+)$", "", token)
            label = IDENTIFIERS.get(name)
            exception = label is None and ("exception" in name or name.endswith("-note"))
            stack.append((set() if exception else {label or name}, label in PERMISSIVE, name))
    return stack[0][0], stack[0][1]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            kinds.setdefault(f" {phrase} ", []).append((kind, label))
    for phrase, what in kinds.items():
        found.add_word(phrase, (len(phrase), what))
    found.make_automaton()
    return found


def scan(text: str, automaton) -> dict:
    """What ``scan_licenses`` returns for one text."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, labels, base, expressions = [], {}, set(), []
    at, passed = -1, 0  # spaces in joined[: at + 1]
    for end, (size, what) in automaton.iter(joined):
        start = end - size + 1
        for kind, label in what:
            if kind == "tag":
                expressions = None
                continue
            labels.setdefault(label, set()).add(kind)
            if kind == "base":
                passed += joined.count(" ", at + 1, start + 1) if start > at else -joined.count(" ", start + 1, at + 1)
                at = start
                places.append(passed - 1)
                base.add(label)
    permissive = None
    if expressions is None:
        expressions = []
        for found in _EXPRESSION.findall(text):
            postfix = to_postfix(found)
            if postfix:
                names, free = evaluate(postfix)
                expressions.append(" ".join(postfix))
                permissive = free if permissive is None else permissive and free
                for name in names:
                    labels.setdefault(name, set()).add("tag")
    doubt = 1.0
    for kinds in labels.values():
        for kind in kinds:
            doubt *= 1 - WEIGHTS[kind]
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1 - doubt, "expressions": expressions, "permissive": permissive,
    }


OUTPUTS = [
    ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()),
    ("labels", T.StringType()), ("score", T.DoubleType()), ("expressions", T.ArrayType(T.StringType())), ("permissive", T.BooleanType()),
]


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence labels of every row, over its whole text.

    ``n_base``, ``first_word`` and ``last_word`` are of the base phrases; ``labels`` adds those of notices and of
    tagged expressions, ``expressions`` are these in postfix order, and ``permissive`` says whether all of them
    can be met by permissive licences (null without one). A malformed expression adds nothing. A null or empty
    text has no words, empty labels and score 0. Repeated rows give repeated results; other columns are not read.
    """

    def worker():
        automaton = _automaton()

        def run(texts, _):
            found = [scan(t, automaton) for t in texts.to_pylist()]
            return [[f[name] for f in found] for name, _ in OUTPUTS]

        return run

    return map_texts(docs, [doc_id], text, OUTPUTS, worker)
