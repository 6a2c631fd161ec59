import re

import pyarrow.parquet as pq
import pytest

from storyloom.llm import license_scan as L

SF = "/root/testdata/sf0.01"


def plain(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base(found):
    return tuple(found[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels"))


def test_base_places_equal_brute_force():
    automaton = L._automaton()
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    texts += ["", "cc by nc cc by nc", "CC-BY-NC; under the MIT License under the mit\nlicense", "Apache License, Version 2.0é", "the Apache License Version 2", "xcc by nc", "cc by ncx", "É cc by nc"]
    for text in texts:
        assert base(L.scan(text, automaton)) == plain(text)


@pytest.mark.parametrize(
    "expression, labels, permissive",
    [
        ("MIT", "mit", True),
        ("GPL-2.0-only OR MIT", "gpl-2,mit", True),
        ("GPL-2.0-or-later AND MIT", "gpl-2,mit", False),
        ("MIT AND (GPL-3.0+ OR Apache-2.0)", "apache-2,gpl-3,mit", True),
        ("MIT OR GPL-3.0 AND GPL-2.0", "gpl-2,gpl-3,mit", True),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", "gpl-2,mit", True),
        ("GPL-2.0 WITH Other-exception AND MIT", "gpl-2,mit", False),
        ("MIT */", "mit", True),
        ("MIT OR", "", None),
        ("(MIT", "", None),
        ("MIT) OR (GPL-2.0", "", None),
        ("MIT GPL-2.0", "", None),
        ("", "", None),
    ],
)
def test_expressions(expression, labels, permissive):
    found = L.scan(f"// SPDX-License-Identifier: {expression}\nint x;", L._automaton())
    assert (found["labels"], found["permissive"]) == (labels, permissive)
    assert 0 <= found["score"] <= 1


def test_notices_add_labels():
    found = L.scan("Under the MIT License. Licensed under the GNU General Public License, version 3.", L._automaton())
    assert found["base_labels"] == "mit" and found["labels"] == "gpl-3,mit"


def test_odd_documents(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licenses(odd_docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *plain(r.text)) for r in odd_docs.select("doc_id", "text").collect()), key=str)
    assert L.scan_licenses(no_docs).collect() == []
