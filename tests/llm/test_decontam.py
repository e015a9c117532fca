import random
import tracemalloc

import pyarrow as pa
from brute import HARD, tiling, words

from formlake.llm import decontam

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def test_tiles_equal_the_plain_method():
    pick = random.Random(1)

    def text(n, letters):
        return " ".join(pick.choice(letters) for _ in range(pick.randint(0, n)))

    found = 0
    for _ in range(400):
        letters = "abcdefgh"[:pick.choice([2, 3, 6])]
        row, items = text(40, letters), [text(20, letters) for _ in range(3)]
        own = {i: (t, c) for _, i, t, c in decontam.contained(
            pa.array([row]), decontam.Items([0, 1, 2], items, 3), 0.0)}
        for i, item in enumerate(items):
            want = tiling(row, item, min(3, max(1, len(words(item)))))
            found += want[0] > 0
            assert own.get(i, (0, 0)) == want
    assert found > 300


def run(spark, docs, rows, items, **more):
    benchmark = spark.createDataFrame(items, "item_id long, text string, doc_id long, kept string")
    out = decontam.contamination(docs(rows), benchmark, **more)
    return sorted((r.doc_id, r.item_id, r.item_words, r.tiles, r.covered_words) for r in out.collect())


def test_whole_reordered_partial_and_clean_texts(spark, docs):
    w = PASSAGE.split()
    rows = [
        (1, f"before {PASSAGE.upper()}\n after"), (2, " ".join(["x", *w[8:], "y", *w[:8], "z"])),
        (3, " ".join(w[:7]) + " other"), (4, "clean words only in this text"), (4, f"q {PASSAGE}"), *HARD[5:],
        (20, " ".join([PASSAGE] * 50)),
    ]
    items = [(100, PASSAGE, 1, "a"), (101, "one two", 1, "a"), (102, None, 1, "a"), (100, PASSAGE, 2, "b")]
    want = [(1, 100, 16, 1, 16)] * 2 + [(2, 100, 16, 2, 16)] * 2 + [(4, 100, 16, 1, 16)] * 2 + [
        (5, 101, 2, 1, 2), (6, 101, 2, 1, 2)] + [(20, 100, 16, 1, 16)] * 2  # an item of two words, word for word
    assert run(spark, docs, rows, items) == want
    assert run(spark, docs, rows, items, block_words=1) == want
    kept = decontam.decontaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string, a long, b string"))
    assert kept.columns == docs(rows).columns
    left = sorted(r.text or "" for r in kept.collect())
    assert left == sorted(t or "" for _, t in rows if PASSAGE not in " ".join(words(t)) and not (t or "").startswith("x iota")
                          and words(t) != ["one", "two"])


def test_items_shorter_than_a_seed(spark, docs):
    rows = [(1, "so What is\nthe capital, he asked"), (2, "what is the"), (3, "the what is capital"), (4, "yes"), (5, None)]
    items = [(1, "what is the capital,", 1, "a"), (2, "what is the", 1, "a"), (3, "YES", 1, "a"), (4, " ", 1, "a"),
             (5, "what is the", 1, "a")]
    assert run(spark, docs, rows, items) == [
        (1, 1, 4, 1, 4), (1, 2, 3, 1, 3), (1, 5, 3, 1, 3), (2, 2, 3, 1, 3), (2, 5, 3, 1, 3), (4, 3, 1, 1, 1)]


def peak(text, items):
    found = decontam.Items(list(range(len(items))), items, 5)
    tracemalloc.start()
    out = list(decontam.contained(pa.array([text]), found, 0.5))
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, size


def test_repeated_words_need_no_memory_for_all_pairs_of_places():
    out, size = peak("a " * 100_000, ["a " * 400, "a a a a a b " * 60, "a " * 30 + "b " * 60])
    assert out == [(0, 0, 1, 400), (0, 1, 60, 300)] and size < 100e6


def test_a_seed_of_many_items_is_looked_at_in_parts(monkeypatch):
    monkeypatch.setattr(decontam, "ENTRIES", 50)
    items = [f"{PASSAGE} {i} {i + 1} {i + 2}" for i in range(300)]
    texts = [PASSAGE, "clean", f"{PASSAGE} " * 40, None, " ".join(PASSAGE.split()[:8])]
    out = list(decontam.contained(pa.array(texts), decontam.Items(list(range(300)), items, 5), 0.5))
    assert sorted(out) == [(r, i, 1, 16) for r in (0, 2) for i in range(300)]


def test_empty_tables(spark, docs):
    assert run(spark, docs, [], [(1, PASSAGE, 1, "a")]) == []
    assert run(spark, docs, [(1, PASSAGE)], []) == []


def test_all_planted_passages(spark, docs, table):
    items, rows = table("benchmark", "item_id", "text"), table("documents", "doc_id", "text")
    out = run(spark, docs, rows, [(*i, 1, "a") for i in items])
    flat = {d: " ".join(words(t)) for d, t in rows}
    whole = {(d, i) for d, t in flat.items() for i, x in items if " ".join(words(x)) in t}
    assert whole and whole <= {r[:2] for r in out}
    for doc_id, item_id, size, tiles, covered in out:
        assert (tiles, covered) == tiling(dict(rows)[doc_id], dict(items)[item_id], 5) and covered >= size / 2
