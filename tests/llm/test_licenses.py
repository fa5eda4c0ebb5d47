import re

import pytest
from cases import documents, empty, prose

from vecbench.llm import licenses as M

TEXTS = [
    (30, "Released under the MIT License."), (31, "mit  LICENSE\nmit-license MIT.License mitlicense mit license"),
    (32, "This work is licensed under the GNU General Public License, version 3."), (33, "Licensed under CC BY-NC 4.0."),
    (34, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */ more"), (35, "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0"),
    (36, '{"name": "x", "license": "MIT OR Apache-2.0"}'), (37, "the license: this is prose, and a licence = unclear"),
    (38, "SPDX-License-Identifier: MIT OR"), (39, "GNU Lesser General Public License"), (40, "mit é license mit license é mit licenseé"),
    (41, "spdx-license-identifier: Foo-1.0"), (42, "license:" * 3000), (43, "mit license " * 4000), (44, "License: LicenseRef-own and (BSD-3-Clause"),
    (45, "general public license apache license " + prose(3, 12_000)), (46, "cc by nc sa"), (47, "SPDX-License-Identifier: " + "(" * 500 + "MIT"),
]


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(k, label) for k in range(len(words)) for phrase, label in M.BASE.items() if words[k : k + len(phrase.split())] == phrase.split()]
    return (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


def test_base_equals_brute_force(spark):
    docs = documents(spark).unionByName(documents(spark, TEXTS))
    want = sorted([(r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()], key=repr)
    got = M.license_scan(docs).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score > 0) == (r.labels != "") for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[k].labels for k in (30, 32, 33, 36, 37, 39, 46)] == ["mit", "gpl", "cc-by-nc", "apache,mit", "", "gpl,lgpl", "cc-by-nc-sa"]
    assert by[34].expressions[0].canonical == "(mit or gpl-2.0-only) and apache-2.0" and by[34].allowed and by[34].labels == "apache,gpl,mit"
    assert by[35].expressions[0].canonical == "gpl-2.0+ with classpath-exception-2.0" and by[35].allowed
    assert by[38].expressions[0].error == "or lacks a side" and by[41].expressions[0].error == "unknown identifier" and by[41].allowed is None
    assert by[47].expressions[0].error == "too long" and by[34].expressions[0].byte == 3


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert sorted(tuple(r)[:6] for r in M.license_scan(docs).collect()) == want
    assert any(w[2] for w in want)


def test_empty_table(spark):
    assert M.license_scan(empty(spark)).count() == 0


def reference_value(tokens, allowed):
    """Recursive descent over fully bracketed triples, as an independent evaluation."""
    def boolean(node):
        if isinstance(node, str):
            return node in allowed
        op, a, b = node
        return (boolean(a) or boolean(b)) if op == "or" else (boolean(a) and boolean(b))
    return boolean(tokens)


@pytest.mark.parametrize("text, canonical, allowed", [
    ("MIT", "mit", True), ("GPL-3.0-only", "gpl-3.0-only", False), ("MIT OR GPL-3.0-only AND GPL-2.0-only", "mit or gpl-3.0-only and gpl-2.0-only", True),
    ("(MIT OR GPL-3.0-only) AND GPL-2.0-only", "(mit or gpl-3.0-only) and gpl-2.0-only", False),
    ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "gpl-2.0-only with classpath-exception-2.0 and mit", True),
    ("((MIT))", "mit", True), ("mit and (isc and (zlib or epl-2.0))", "mit and isc and (zlib or epl-2.0)", True),
])
def test_expressions(text, canonical, allowed):
    value = M.evaluate(M.postfix(M.tokens_of(text.encode())))
    assert (value.text, value.allowed, value.known) == (canonical, allowed, True)
    again = M.evaluate(M.postfix(M.tokens_of(value.text.encode())))
    assert again == value


def test_random_expressions_equal_a_recursive_evaluation():
    import random
    rnd = random.Random(4)
    names = ["mit", "isc", "gpl-2.0", "epl-2.0", "zlib"]

    def make(depth):
        return rnd.choice(names) if depth == 0 or rnd.random() < 0.3 else (rnd.choice(["or", "and"]), make(depth - 1), make(depth - 1))

    def text(node):
        return node if isinstance(node, str) else f"({text(node[1])} {node[0]} {text(node[2])})"

    for _ in range(300):
        node = make(5)
        got = M.evaluate(M.postfix(M.tokens_of(text(node).encode())))
        assert got.allowed == reference_value(node, {"mit", "isc", "zlib"})
        assert M.evaluate(M.postfix(M.tokens_of(got.text.encode()))) == got


@pytest.mark.parametrize("text", ["MIT AND", "(MIT", "AND MIT", "", "(MIT) WITH (LLVM-exception OR MIT)", "(MIT OR ISC) WITH LLVM-exception"])
def test_broken_expressions(text):
    with pytest.raises(M.ExpressionError):
        M.evaluate(M.postfix(M.tokens_of(text.encode())))
