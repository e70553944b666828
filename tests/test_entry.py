"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_of_sql_are_names_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_subpackage(tmp_path):
    for name in ("tallyforge", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_core_tests_pass_without_the_subpackage(tmp_path):
    """The fast modules; the others import nothing else of the package than these."""
    for name in ("tallyforge", "tests", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    done = subprocess.run([sys.executable, "-m", "pytest", "tests/test_text.py", "tests/test_rules.py", "-x", "-q"], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-3000:]


def test_a_broken_subpackage_takes_nothing_else_with_it(tmp_path):
    for name in ("tallyforge", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / name
        if src.exists():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    (tmp_path / "tallyforge" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100"], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("name", [
    "extract_fields", "dup_groups", "quote_match", "status_counts", "folder_path", "rule_ab_diff", "match_decision", "match_decision_analogs", "quote_assignment", "filtered_candidates", "goods_fields", "cell_quantity", "delimited_files",
    "recognised_documents", "scored_columns", "request_rows", "row_traces", "scored_matches",
])
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, d)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((key(r) for r in got.select(names).collect())) == sorted(key(r) for r in want)
