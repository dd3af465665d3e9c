"""The driver's contract, with and without the training-data operators."""

import json
import re
import subprocess
import sys

from conftest import ROOT

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("sparrowtext.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(k.startswith("op") or k == "pipeline" for k in e.queries()), list(e.queries())
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
"""


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["doc", "score"] and out.count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "sparrowtext").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_bench_names_exist():
    import __spark_entry__ as e
    import bench

    assert set(bench.HEADLINE) <= set(e.queries())


def test_commands(spark, tmp_path, capsys):
    from sparrowtext.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("The quick fox")
    (tmp_path / "in" / "two.txt").write_text("the slow fox")
    at = f"file://{tmp_path}/ix"
    main(["index", f"{tmp_path}/in", at], spark)
    main(["query", at, "+fox quick", "slow"], spark)
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(x["query"], x["rank"], x["path"].rsplit("/", 1)[1], x["hits"]) for x in out] == [(0, 1, "one.txt", 2), (0, 2, "two.txt", 2), (1, 1, "two.txt", 1)]
    main(["terms", at, "--prefix", "s"], spark)
    main(["summary", at], spark)
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "slow\t1\t1" and len(lines) == 6
