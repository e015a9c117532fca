import math
import textwrap
from collections import Counter

import pytest
from brute import python_nodes

from formlake.llm import licenses

TEXTS = {
    "MIT": licenses.TEMPLATES[2].text, "Apache-2.0": licenses.TEMPLATES[4].text, "GPL-3.0": licenses.TEMPLATES[6].text,
    "BSD-3-Clause": licenses.TEMPLATES[9].text,
}
WORDS = "the of and to any this software is a free version in you may use it with for by license".split()
FILLER = [(f"src/f{i}.txt", " ".join(WORDS[i % 7:i % 7 + 9]) + ".\nmore text\n" * 3) for i in range(60)]


def scan(spark, rows):
    out = licenses.license_scan(spark.createDataFrame(rows, "path string, text string"))
    assert python_nodes(out) == []
    return {r.path: (r.license, r.origin, r.from_dir) for r in out.collect()}


def best(rows, text):
    """The best cosine of any run of as many terms as a template has, by trying all of them."""
    held = [set(licenses.terms(t)) for _, t in rows]
    words = licenses.re.findall(licenses.TERM, text.lower())

    def weigh(counts):
        return {t: n * (math.log((len(rows) + 1) / (1 + sum(t in h for h in held if t in vocabulary)) ) + 1)
                for t, n in counts.items()}

    vocabulary = {t for x in licenses.TEMPLATES for t in licenses.terms(x.text)}
    top = 0.0
    for x in licenses.TEMPLATES:
        own = weigh(licenses.terms(x.text))
        n = sum(licenses.terms(x.text).values())
        for s in range(max(1, len(words) - n + 1)):
            run = weigh(Counter(words[s:s + n]))
            dot = sum(w * run.get(t, 0) for t, w in own.items())
            top = max(top, dot / math.sqrt(sum(w * w for w in own.values()) * sum(w * w for w in run.values())))
    return top


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_wrapped_notices(spark, prefix):
    rows = [*FILLER]
    for name, text in TEXTS.items():
        body = "\n".join(prefix + line for line in textwrap.wrap(text, 40))
        rows.append((f"{name}/x.c", f"Copyright 2020 somebody\n{body}\nint main\n" + "other code here\n" * 30))
    got = scan(spark, rows)
    assert {name: got[f"{name}/x.c"][:2] for name in TEXTS} == {name: (name, "notice") for name in TEXTS}
    assert all(got[path][0] is None for path, _ in FILLER)


def test_notice_inside_a_paragraph_and_inherited_license_file(spark):
    inline = "This package has been around for years and is Released under the MIT License. See the manual for more of it."
    wrapped = "\n".join(textwrap.wrap(f"Copyright (c) 2021 A. Person. All rights reserved. {TEXTS['BSD-3-Clause']}:", 50))
    rows = [*FILLER, ("a/readme", inline), ("b/LICENSE", wrapped), ("b/c/d.py", "nothing"), ("short/COPYING", "Released\nunder the\nMIT License"),
            ("short/x", None)]
    got = scan(spark, rows)
    assert got["a/readme"] == ("MIT", "notice", None)
    assert got["b/LICENSE"] == ("BSD-3-Clause", "notice", None) and got["b/c/d.py"] == ("BSD-3-Clause", "directory", "b")
    assert got["short/x"] == ("MIT", "directory", "short")


def test_every_window_is_scored(spark):
    """Damaged notices between other words are found exactly where trying all windows finds them."""
    rows = [*FILLER]
    for k in range(1, 9):
        for name, text in TEXTS.items():
            words = text.split()
            cut = " ".join(w if i % 9 >= k else "zz" for i, w in enumerate(words))
            rows.append((f"d{k}{name}/x", f"some words before it {cut} and some more\nafter it"))
    got = scan(spark, rows)
    want = {p: best(rows, t) for p, t in rows if p.startswith("d")}
    assert {p: got[p][0] is not None for p in want} == {p: s >= licenses.THRESHOLD for p, s in want.items()}
    assert {s >= licenses.THRESHOLD for s in want.values()} == {True, False}
