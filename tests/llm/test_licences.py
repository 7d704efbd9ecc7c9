"""Licence scans against plain word search, and the expression parser."""

import itertools
import random
import re
import time

import pytest

from plinth.llm import licences as L


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def places(own, phrase):
    want = phrase.split()
    return [i for i in range(len(own) - len(want) + 1) if own[i : i + len(want)] == want]


def plain(doc_id, text):
    own = plain_words(text)
    base = [(i, label) for p, label in L.BASE.items() for i in places(own, p)]
    notices = {label for p, (label, _) in L.NOTICES.items() if places(own, p)}
    at = [i for i, _ in base]
    return (doc_id, len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | notices)))


def test_summary_matches_plain_search(spark):
    rng = random.Random(6)
    pieces = [*L.BASE, *L.NOTICES, "mit", "license", "general public", "the", "É", "MIT License", "Apache-License,", "mit\nlicense", "mitlicense", "public license"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randrange(12)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "mit license mit license"), (None, "MIT license"), (203, "x " * 40000 + "mit license"), (3, rows[3][1]), (204, "mit×license mit license")]
    frame = spark.createDataFrame([(d, t, "a", 2.0) for d, t in rows], "doc_id long, text string, labels string, score double")
    got = L.summary(frame)
    found = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()
    assert sorted(map(tuple, found), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got.collect())
    assert L.summary(frame.limit(0)).count() == 0


@pytest.mark.parametrize("expression,labels,free", [
    ("MIT", ["mit"], True),
    ("GPL-3.0-or-later", ["gpl"], False),
    ("MIT OR GPL-2.0-only", ["mit", "gpl"], True),
    ("MIT AND GPL-2.0-only", ["mit", "gpl"], False),
    ("MIT OR GPL-2.0-only AND LGPL-2.1", ["mit", "gpl", "lgpl"], True),
    ("(MIT OR GPL-2.0-only) AND LGPL-2.1", ["mit", "gpl", "lgpl"], False),
    ("GPL-2.0+ WITH Classpath-exception-2.0 or Apache-2.0", ["gpl", "apache"], True),
    ("((LicenseRef-Own))", ["licenseref-own"], False),
])
def test_expressions(expression, labels, free):
    assert L.evaluate(L.postfix(expression)) == (labels, free)


@pytest.mark.parametrize("expression", ["", "AND", "MIT OR", "(MIT", "MIT)", "MIT Apache-2.0", "MIT OR OR BSD", "()", "MIT / BSD"])
def test_malformed(expression):
    assert L.postfix(expression) is None


def test_with_takes_single_licences():
    assert L.evaluate(L.postfix("(MIT OR ISC) WITH x")) is None


def test_parser_agrees_with_python_on_random_expressions():
    rng = random.Random(4)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["MIT", "GPL-2.0", "ISC", "MPL-2.0"])
        text = f"{make(depth - 1)} {rng.choice(['AND', 'or'])} {make(depth - 1)}"
        return f"({text})" if rng.random() < 0.5 else text

    value = {"MIT": True, "GPL-2.0": False, "ISC": True, "MPL-2.0": False}
    for _ in range(300):
        text = make(4)
        python = text.replace("AND", "and")
        for name, free in value.items():
            python = python.replace(name, str(free))
        assert L.evaluate(L.postfix(text))[1] == eval(python)


def test_tags(spark):
    rows = [
        (1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nint x;"), (2, "/* spdx-license-identifier: Apache-2.0 WITH LLVM-exception */"),
        (3, "SPDX-License-Identifier: MIT OR\nmit license"), (4, "License-Expression: ISC\r\nSPDX-License-Identifier: MPL-2.0"),
    ]
    got = {r.doc_id: (r.labels, r.base_labels, r.permissive) for r in L.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("bsd,gpl,mit", "", True), 2: ("apache", "", True), 3: ("mit", "mit", None), 4: ("isc,mpl", "", False)}
    assert list(itertools.chain(L.scan_text(None))) == [0, [], []]


def test_long_runs_of_blanks_take_linear_time():
    blanks = " " * 1_000_000
    for text in (f"SPDX-License-Identifier: MIT{blanks}x", f"SPDX-License-Identifier:{blanks}MIT{blanks}", f"License-Expression{blanks}: MIT{blanks}*/", f"SPDX-License-Identifier: {'( ' * 300_000}"):
        began = time.process_time()
        L.scan_text(text)
        assert time.process_time() - began < 5


def test_ends_of_comments():
    for rest, want in (("MIT */", "MIT"), ("MIT --> ", "MIT"), ("MIT ; x */", "MIT"), ("MIT", "MIT"), ("", ""), ("MIT # x", "MIT"), ("MIT*/ -->", "MIT*/")):
        assert L._expression(rest) == want
