import textwrap

import pyarrow as pa
from brute import SF, python_nodes

from formlake.llm import licenses

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."


def scan(spark, rows):
    ddl = "path string, text string, file string, license string, dir string"
    df = spark.createDataFrame([(*r, "f", "l", "d") for r in rows], ddl)
    out = licenses.license_scan(df)
    assert python_nodes(out) == []
    return sorted(((r.path, r.license, r.origin, r.from_dir) for r in out.collect()), key=str)


def test_same_rows_as_sql(spark, duck):
    df = licenses.document_files(spark.read.parquet(f"{SF}/documents.parquet"))
    got = licenses.license_scan(df, id_col="doc_id")
    columns = ["doc_id", "path", "license", "origin", "from_dir", "similarity"]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({licenses.license_sql()})").fetchall()
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, want))
    assert any(r[3] == "notice" for r in want)


def test_same_rows_as_sql_with_wrapped_and_inline_notices(spark, duck):
    """Among all documents: notices over several lines, inside paragraphs, damaged, and whole notice files."""
    base = duck.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    rows, planted = [*base], []
    for i, t in enumerate(licenses.TEMPLATES):
        cut = " ".join(w if k % 7 else "zz" for k, w in enumerate(t.text.split()))
        for text in ("\n".join(textwrap.wrap(t.text, 30)), f"Some {t.text} and more", f"a\nb {cut}\nc", "word " * 80 + "\n".join(
                textwrap.wrap(t.text, 40)) + " word\nmore" * 80):
            planted.append(10_000 + len(planted))
            rows.append((planted[-1], text, "en", f"planted{i % 3}", len(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    duck.register("given", pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))))
    duck.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM given")
    got = licenses.license_scan(licenses.document_files(df), id_col="doc_id")
    columns = ["doc_id", "path", "license", "origin", "from_dir", "similarity"]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({licenses.license_sql()})").fetchall()
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, want))
    assert sum(r[0] in planted and r[3] == "notice" for r in want) >= 30


def test_notices_and_nearest_ancestors(spark):
    rows = [
        ("LICENSE", MIT), ("a/x.py", "no notice here"), ("a/b/COPYING.txt", f"some words\n{GPL}\nmore"),
        ("a/b/c/y.py", "nothing"), ("a/b/c/z.py", f"{'line of text ' * 3000}\n# {APACHE.upper()}"), ("ab/x", "no"),
        ("q.py", None), (None, "text"), (None, MIT), ("a/x.py", "no notice here"), ("e/LICENSE", "not a license text"),
        ("e/f", ""), ("a/licenses/x", "the license of the apache people is a version of a long story told here"),
    ]
    assert scan(spark, rows) == sorted([
        ("LICENSE", "MIT", "notice", None), ("a/x.py", "MIT", "directory", ""), ("a/b/COPYING.txt", "GPL-3.0", "notice", None),
        ("a/b/c/y.py", "GPL-3.0", "directory", "a/b"), ("a/b/c/z.py", "Apache-2.0", "notice", None),
        ("ab/x", "MIT", "directory", ""), ("q.py", "MIT", "directory", ""), (None, None, None, None),
        (None, "MIT", "notice", None), ("a/x.py", "MIT", "directory", ""), ("e/LICENSE", "MIT", "directory", ""),
        ("e/f", "MIT", "directory", ""), ("a/licenses/x", "MIT", "directory", ""),
    ], key=str)


def test_no_rows(spark):
    assert scan(spark, []) == []
