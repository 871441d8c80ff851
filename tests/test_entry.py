import math
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from foliospark import plans
from foliospark.operators import repair as R

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got, sql = plans.QUERIES[name](spark, SF), plans.ORACLES[name]
    want = duck.execute(sql).df()
    kinds = dict(zip(*(duck.execute("DESCRIBE " + sql).df()[c] for c in ("column_name", "column_type")), strict=True))
    assert {c: KINDS.get(t, t) for c, t in got.dtypes} == kinds
    assert rows(got.toPandas()) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_repaired_pages_are_those_of_plain_python(spark):
    lines = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").collect():
        lines.setdefault(r.l_orderkey, []).append(r[1:])
    found = plans.QUERIES["q43_repair_markdown"](spark, SF).collect()
    assert len(found) == len(lines)
    for r in found:
        own = [(n, part, f"{n}) part {part}") for n, (_, part, *_) in enumerate(sorted(lines[r.l_orderkey]), 1)]
        md = "\n\n".join(t for _, part, t in own if part % 3)
        assert r.markdown == R.repair(md, [{"text": t, "box": [100.0, 50.0 * n, 900.0, 50.0 * n + 30]} for n, _, t in own])


def test_scans_are_cut_in_the_middle(spark):
    got = plans.QUERIES["q45_raster_split"](spark, SF).collect()
    assert {r.side for r in got} == {"left", "right"} and all(48 <= r.split_column <= 72 and r.page_layout == "two-up" and r.recovery_width == 2 * r.page_width for r in got)


def test_imports_without_the_removable_parts(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "foliospark"), tmp_path / "foliospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 40; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_imports_the_removable_parts():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "foliospark")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "foliospark.llm" not in f.read()
