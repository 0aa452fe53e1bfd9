import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-2000:]
    return [set(line.split()) for line in said.stdout.splitlines()[-2:]]


def test_queries_are_there_without_the_text_operators(tmp_path):
    root = str(tmp_path / "copy")
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    whole, part = names(ROOT)[0], names(root)
    assert part[0] == {n for n in whole if not n.startswith("op") and n != "pipeline"}
    assert part[1] <= part[0] and len(part[0]) > 50
    if os.path.exists(pipeline := os.path.join(root, "corpus_pipeline.py")):
        os.remove(pipeline)
        assert names(root)[0] == part[0]


def test_queries_are_there_where_a_package_of_the_text_operators_is_missing(tmp_path):
    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError('not here')")
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-2000:]
    queries, oracles = (set(line.split()) for line in said.stdout.splitlines()[-2:])
    assert len(queries) > 50 and oracles <= queries and not any(n.startswith("op") for n in queries - {"pipeline"})


def test_every_sql_has_a_query():
    queries, oracles = names(ROOT)
    assert oracles <= queries
