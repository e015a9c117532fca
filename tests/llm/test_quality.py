from brute import HARD, python_nodes

from formlake.llm import quality


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def sql_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


def test_same_counts_as_sql(docs, table, duck):
    own = quality.quality(docs(table("documents", "doc_id", "text")))
    assert python_nodes(own) == []
    assert rows_of(own) == sql_rows(duck, quality.quality_sql())


def test_hard_rows(docs, duck):
    extra = [
        (40, "a b c d e a b c d e"), (41, "x x x x x x"), (42, "x x x x x"), (43, "a b c d e f a b c d g a b c d e"),
        (44, "l one\nl one\n\n\nl one\r\n l one\nend"), (45, "#*$ %&| <> plain\x0bword\x0cnext"), (46, "a  b"),
    ]
    rows = [(i, t) for i, t in [*HARD, *extra] if i is not None]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    duck.execute("CREATE TABLE hard (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO hard VALUES (?, ?)", numbered)
    own = quality.quality(docs(numbered))
    assert rows_of(own) == sql_rows(duck, quality.quality_sql(table="hard"))
    by = {r.doc_id: r for r in quality.quality(docs([*HARD, *extra])).collect()}
    assert (by[40].n_repeat_words, by[41].n_repeat_words, by[42].n_repeat_words, by[43].n_repeat_words) == (10, 6, 0, 10)
    assert (by[44].n_dup_lines, by[44].n_lines) == (1, 5) and by[45].n_symbols == 8
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert len(quality.quality(docs(HARD)).collect()) == len(HARD) and quality.quality(docs([])).count() == 0


def test_thresholds_are_compiled_from_the_table(docs):
    rows = [(1, "word " * 3 + "# # #"), (2, "plain words in a row")]
    rule = quality.Rule("many_symbols", "n_symbols", "n_words", high=0.4)
    got = {r.doc_id: r.failed_rule for r in quality.quality(docs(rows), rules=[rule]).collect()}
    assert got == {1: "many_symbols", 2: None}


def test_filter_keeps_whole_rows_and_clean_texts(docs, table):
    rows, labels = table("documents", "doc_id", "text"), dict(table("labels", "doc_id", "quality"))
    df = docs(rows)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and python_nodes(kept) == []
    ids = {r.doc_id for r in kept.collect()}
    verdicts = {r.doc_id: r for r in quality.quality(df).collect()}
    assert ids == {i for i, r in verdicts.items() if r.kept}
    assert all(i in ids for i, q in labels.items() if q == 1 and i in verdicts and not verdicts[i].base_failed)
    assert not any(i in ids for i, q in labels.items() if q == 0)
    assert quality.keep_good(docs(HARD)).count() == sum(r.kept for r in quality.quality(docs(HARD)).collect())
