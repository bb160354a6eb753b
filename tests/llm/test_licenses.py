import re

import pytest

from llm.helpers import documents, edge_rows, ordered, random_texts
from pagetide.llm import licenses
from pagetide.llm.license_rules import GATE, rules


def brute(doc_id, text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = sorted(
        (i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()
    )
    return (
        doc_id, len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None,
        ",".join(sorted({label for _, label in found})),
    )


def test_base_places_match_brute_force(spark):
    rows = edge_rows() + [
        (100, "CC BY and cc-by, cc\x00by; ccby; acc by; cc bye; CC_BY", "a"),
        (101, "General\nPublic  LICENSE general public licenses é general public license", "a"),
        (102, "all rights reserved" * 3 + " All Rights, Reserved! éall rights reserved", "a"),
    ] + [(200 + i, t + " cc by " + t[:50], "a") for i, t in enumerate(random_texts(2, 20))]
    got = licenses.scan(documents(spark, rows, extra=True)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert ordered(got.collect()) == ordered(brute(d, t) for d, t, _ in rows)


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0,gpl"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,cc-by"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("see https://creativecommons.org/licenses/by-sa/3.0/", "CC-BY-SA-3.0"),
    ("The admitted permit was plain prose.", ""),
])
def test_rules_and_suppression(spark, text, labels):
    out = licenses.scan(documents(spark, [(1, text, "a")])).collect()[0]
    assert out.labels == labels
    assert 0 <= out.score <= 1 and (out.score > 0) == bool(labels)


def test_gate_covers_every_rule():
    """A text that a rule matches passes the gate: each rule's own keyword or a
    literal of its pattern is in the gate."""
    assert len(rules()) > 200
    gate = re.compile(GATE)
    for r in rules():
        assert any(gate.search(k) for k in r.keywords) or gate.search(r.pattern.replace("\\", "").replace("[cs]", "s")), r


def test_empty_table(spark):
    assert licenses.scan(documents(spark, edge_rows()).limit(0)).count() == 0


def samples(parsed):
    """Texts of a parsed regex that take each of its alternatives and options."""
    options = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            options.append([chr(arg)])
        elif name == "BRANCH":
            options.append([x for branch in arg[1] for x in samples(branch)])
        elif name == "SUBPATTERN":
            options.append(samples(arg[3]))
        elif name == "MAX_REPEAT":
            lo, hi, body = arg
            texts = samples(body)
            options.append((texts if hi else []) + (["\n".join(texts[:1]) if lo else ""] if not lo else []))
        elif name == "IN":
            kinds = {str(a): b for a, b in arg}
            if "CATEGORY" in kinds:
                options.append(["\n"] if str(kinds["CATEGORY"]) == "CATEGORY_SPACE" else ["x"])
            else:
                options.append([chr(b if str(a) == "LITERAL" else b[0]) for a, b in arg])
    n = max(map(len, options), default=1)
    return ["".join(o[i % len(o)] for o in options) for i in range(n)]


def test_every_alternative_of_every_rule_is_found(spark):
    """The rule alone, as a whole text, wrapped at each blank: no gate drops it."""
    rows, least = [], {}
    for r in rules():
        for t in samples(re._parser.parse(r.pattern)):
            if re.search(r.pattern, t):
                least[len(rows)] = r.priority / 100
                rows.append((len(rows), t, "a"))
    assert len(rows) > 2 * len(rules())
    got = {d.doc_id: d.score for d in licenses.scan(documents(spark, rows)).select("doc_id", "score").collect()}
    assert [(rows[i][1], s) for i, s in least.items() if got[i] < s] == []


@pytest.mark.parametrize("text,labels", [
    ("It may not be copied.", "proprietary"),
    ("provided 'as-is'", "warranty-disclaimer"),
    ("GNU general public licence", "GPL"),
    ("available under Apache-2.0", "Apache-2.0"),
    ("distributed under the GPL-3.0", "GPL-3.0"),
    ("released under the GNU General\nPublic License,\nversion 3", "GPL-3.0,gpl"),
    ("SPDX-License-Identifier: CPL-1.0", "CPL-1.0"),
])
def test_gates_keep_what_rules_match(spark, text, labels):
    assert licenses.scan(documents(spark, [(1, text, "a")])).collect()[0].labels == labels
