"""Licence scan: phrases and tags by Aho-Corasick, tag expressions by a shunting-yard parser.

The words of a lower-cased text are joined by single spaces and read once by one automaton that holds all phrases.
Where it meets an identifier tag, the expression after the tag is parsed from the text itself. All of it happens
inside one row, so nothing is shuffled and no text is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.wording import words

# The phrases that every scan counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases of notices: what stands in the text, the label, and how sure the phrase alone is.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "zlib license": ("zlib", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "creative commons attribution": ("cc-by", 0.6),
    "licensed under cc by": ("cc-by", 0.8),
    "licensed under cc by sa": ("cc-by-sa", 0.8),
    "licensed under cc by nc": ("cc-by-nc", 0.8),
    "licensed under cc by nd": ("cc-by-nd", 0.8),
    "licensed under cc by nc sa": ("cc-by-nc-sa", 0.8),
    "licensed under cc by nc nd": ("cc-by-nc-nd", 0.8),
    "cc0 1 0 universal": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("proprietary", 0.5),
}
TAGS = ("spdx license identifier", "license expression")
BASE_SURE, TAG_SURE = 0.8, 0.95
_TAG = re.compile(r"(?:spdx[-_ ]license[-_ ]identifier|license[-_ ]expression)\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_AFTER = re.compile("[;,\"'#]")
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
#: How strongly the operators of an expression bind.
BINDS = {"or": 1, "and": 2, "with": 3}
#: Beginnings of identifiers and the labels they belong to; the first that fits counts.
FAMILIES = (
    ("mit", "mit"), ("apache", "apache"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("bsd", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("mpl", "mpl"), ("epl", "epl"), ("cc0", "cc0"),
    ("cc-by-nc-sa", "cc-by-nc-sa"), ("cc-by-nc-nd", "cc-by-nc-nd"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("unlicense", "public-domain"),
)
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "zlib", "cc0", "cc-by", "public-domain"})


class Finding(NamedTuple):
    """A place in the text: ``kind`` base, notice or tag; ``first_word`` from 0; ``text`` the phrase or expression."""

    kind: str
    label: str
    first_word: int
    text: str
    sure: float


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds = [(p, ("base", label, BASE_SURE)) for p, label in BASE.items()]
    kinds += [(p, ("notice", label, sure)) for p, (label, sure) in NOTICES.items()] + [(p, ("tag", "", TAG_SURE)) for p in TAGS]
    for phrase, what in kinds:
        found.add_word(f" {phrase} ", (len(phrase) + 2, phrase, what))
    found.make_automaton()
    return found


def postfix(expression: str) -> list[str] | None:
    """Operands and operators of a licence expression in postfix order (shunting-yard); None if it is malformed."""
    out, waiting, operand_next, at = [], [], True, 0
    expression = expression.rstrip()
    while at < len(expression):
        token = _TOKEN.match(expression, at)
        if token is None:
            return None
        at = token.end()
        word = token[1] or token[2]
        binds = BINDS.get(word.lower())
        if word == "(" and operand_next:
            waiting.append("(")
        elif word == ")" and not operand_next:
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif binds and not operand_next:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= binds:
                out.append(waiting.pop())
            waiting.append(word.lower())
            operand_next = True
        elif not binds and word not in "()" and operand_next:
            out.append(word)
            operand_next = False
        else:
            return None
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def family(identifier: str) -> str:
    """The label of a licence identifier; an unknown one is its own label in lower case."""
    low = identifier.lower()
    return next((label for start, label in FAMILIES if low == start or low.startswith((start + "-", start + "+"))), low)


def evaluate(steps: list[str]) -> tuple[list[str], bool] | None:
    """Licences of a postfix expression and whether it can be met under permissive terms alone: one side of an ``or``
    does, both sides of an ``and`` must, and ``with`` only adds an exception to the licence on its left."""
    stack: list[tuple[list[str], bool, bool]] = []
    for step in steps:
        if step not in BINDS:
            stack.append(([family(step)], family(step) in PERMISSIVE, True))
            continue
        (right, right_free, right_single), (left, left_free, left_single) = stack.pop(), stack.pop()
        if step == "with":
            if not (left_single and right_single):
                return None
            stack.append((left, left_free, False))
        else:
            stack.append((left + right, left_free or right_free if step == "or" else left_free and right_free, False))
    return stack[0][0], stack[0][1]


def _expression(rest: str) -> str:
    """What follows a tag on its line, without the end of a comment."""
    end = _AFTER.search(rest)
    if end:
        return rest[: end.start()].rstrip()
    rest = rest.rstrip()
    return rest.removesuffix("*/" if rest.endswith("*/") else "-->").rstrip()


def scan_text(text: str | None) -> tuple[int, list[Finding], list[bool]]:
    """Number of words, findings in order of place, and the value of each well-formed tag expression."""
    own = words((text or "").encode("utf-8", "surrogatepass"))
    findings, values, starts = [], [], None
    joined = " " + b" ".join(own).decode("latin-1") + " "
    tagged = False
    for end, (size, phrase, (kind, label, sure)) in automaton().iter(joined):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        place = int(np.searchsorted(starts, end - size + 1))
        if kind == "tag":
            tagged = True
        else:
            findings.append(Finding(kind, label, place, phrase, sure))
    if tagged:
        place, at = 0, 0
        for match in _TAG.finditer(text):
            place, at = place + len(words(text[at : match.start()].encode("utf-8", "surrogatepass"))), match.start()
            expression = _expression(match[1])
            steps = postfix(expression)
            met = evaluate(steps) if steps else None
            if met is not None:
                values.append(met[1])
                findings += [Finding("tag", label, place, expression, TAG_SURE) for label in dict.fromkeys(met[0])]
    return len(own), sorted(findings, key=lambda f: f.first_word), values


SCAN = "doc_id long, n_words long, findings array<struct<kind:string,label:string,first_word:int,text:string>>, score double, permissive boolean"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, findings, score, permissive`` for every row of ``docs`` (``doc_id, text``).

    ``score`` is the chance that the text states a licence, taking its different findings as independent: 1 minus
    the product of what each leaves unsure (equal phrases count once). ``permissive`` says whether all well-formed tag
    expressions can be met under permissive terms, null without one. A malformed expression finds nothing. Null and
    empty texts have no words and no findings; repeated rows repeat; an empty table gives none.
    """
    place = pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            findings = [[{"kind": f.kind, "label": f.label, "first_word": f.first_word, "text": f.text} for f in found] for _, found, _ in rows]
            unsure = [float(np.prod([1 - s for s in {(f.kind, f.label, f.text): f.sure for f in found}.values()])) for _, found, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array(findings, pa.list_(place)),
                    pa.array([1 - u for u in unsure], pa.float64()), pa.array([all(v) if v else None for _, _, v in rows], pa.bool_()),
                ],
                ["doc_id", "n_words", "findings", "score", "permissive"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN)


def summary(docs: DataFrame) -> DataFrame:
    """``scan`` as counts and label lists: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive``."""
    base = F.filter("findings", lambda f: f["kind"] == "base")
    places = F.transform(base, lambda f: f["first_word"])

    def labels(findings):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["label"]))), ",")

    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("findings")).alias("labels"), "score", "permissive",
    )
