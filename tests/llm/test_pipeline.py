import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from brute import HARD, SF, near_components, tiling, words

import __spark_entry__ as contract
from formlake.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_stages_against_plain_python(spark, docs, table):
    rows = [*table("documents", "doc_id", "text"), *((i if i is None else i + 10_000, t) for i, t in HARD)]
    items = table("benchmark", "item_id", "text")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "packing"]
    df = docs(rows)
    good = stages["quality_rules"](spark, df, SF)
    kept = [(r.doc_id, r.text) for r in good.collect()]
    assert good.columns == df.columns and 0 < len(kept) < len(rows)
    assert set(kept) <= set(rows)

    alone = stages["near_duplicates"](spark, docs(kept), SF)
    left = [(r.doc_id, r.text) for r in alone.collect()]
    assert alone.columns == df.columns
    assert sorted(left, key=str) == sorted(
        {r for r, (_, c) in zip(kept, near_components(kept), strict=True) if r[0] == c}, key=str)

    clean = stages["decontamination"](spark, docs(left), SF)
    assert clean.columns == df.columns
    flat = [(i, " ".join(words(x))) for i, x in items]

    def contaminated(text):
        t = " ".join(words(text))
        return any(x in t or tiling(text, x, 5)[1] >= 0.5 * len(x.split()) for _, x in flat if set(x.split()) <= set(t.split()))

    last = [(r.doc_id, r.text) for r in clean.collect()]
    assert set(last) <= set(left) and not any(contaminated(t) for _, t in last)
    assert all(contaminated(t) for t in {t for _, t in left} - {t for _, t in last})

    packed = stages["packing"](spark, docs(last), SF)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in last}


def test_empty_table_passes_all_stages(spark, docs):
    df = docs([])
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0


def test_run_is_registered_and_whole(spark):
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_operator_has_one_query():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(contract.queries())


def test_the_rest_works_without_this_folder(tmp_path):
    """As when the folder and corpus_pipeline.py are not there."""
    for path in ROOT.rglob("*.py"):
        part = path.relative_to(ROOT)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py":
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).symlink_to(path)
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') and n[2].isdigit()])"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.strip().endswith("[]")
