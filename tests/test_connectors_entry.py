import glob
import os

import duckdb
import pytest

import __spark_entry__ as E
from gridpulse import schema as S
from gridpulse.queries import QUERIES
from gridpulse.sources import connectors as C
from helpers import message, messages_df

SF = "/root/testdata/sf0.001"


def test_single_csv_is_sorted(spark, scratch):
    path = scratch("single-csv")
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k int, n int").repartition(5)
    C.write_single_csv(df, path, sort_by=["k", "n"])
    files = glob.glob(os.path.join(path.removeprefix("file:"), "part-*.csv"))
    assert len(files) == 1
    back = [tuple(map(int, line.split(","))) for line in open(files[0]).read().splitlines()[1:]]
    assert back == sorted(back)


def test_read_complaints_from_csv_keeps_text_keys(spark, scratch):
    path = scratch("csv-src")
    rows = [message(key="007", incident_zip="01234"), message(key="8", lat="", ctype="Noise x"),
            message(key="9", ctype="Parking")]
    C.write_csv(messages_df(spark, rows, meta=False), path)
    out = C.read_complaints(spark, path=path).collect()
    assert [(r.unique_key, r.incident_zip, r.latitude) for r in out] == [("007", "01234", 40.5)]
    with pytest.raises(ValueError):
        C.read_complaints(spark)


def test_jdbc_options():
    cfg = C.JdbcConfig(url="jdbc:postgresql://db/x", user="u", password="p", driver="org.postgresql.Driver")
    part = C.JdbcPartitioning("created_date", "2024-01-01", "2024-02-01", 16)
    opts = C.jdbc_read_options(cfg, "noise_complaints", part)
    assert opts["partitionColumn"] == "created_date" and opts["numPartitions"] == "16"
    w = C.jdbc_write_options(cfg, "complaint_grid_rollups")
    assert w["truncate"] == "true" and w["batchsize"] == "500"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["lat", "lon", "count", "lat_bucket", "lon_bucket", "zoom_level", "latest_created_date"]


def test_every_query_has_oracle_or_is_listed():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) - set(E.oracle_sql()) == set()


def test_training_data_queries_are_optional(spark):
    """Without the subpackage and the pipeline the entry module still imports and lists all other queries."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import importlib.abc, sys\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('gridpulse.llm'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'grid_live' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql().keys() == e.queries().keys()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


@pytest.mark.parametrize("newline", [False, True])
def test_csv_text_is_rfc_4180(spark, scratch, newline):
    """A file written by another program, and our own, give every text back."""
    import csv

    texts = ['Loud "Music", party', " blanks ", "a,b", "tab\there", '""', "back\\slash\\"] + ["two\nlines"] * newline
    rows = [message(key=str(i), descriptor=t) for i, t in enumerate(texts)]
    own, other = scratch("csv-own"), scratch("csv-other")
    C.write_csv(messages_df(spark, rows, meta=False), own)
    folder = other.removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/rows.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(S.MESSAGE_SCHEMA.fieldNames())
        out.writerows([["" if r[c] is None else r[c] for c in S.MESSAGE_SCHEMA.fieldNames()] for r in rows])
    for path in (own, other):
        back = C.read_text_records(spark, path, multi_line=newline).collect()
        assert sorted((r.unique_key, r.descriptor, r.latitude) for r in back) == sorted((str(i), t, "40.5") for i, t in enumerate(texts))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from gridpulse.session import checkpoint_root

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        sparkContext = None  # as with Spark Connect

        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session(spark_master="spark://host:7077"))
    assert checkpoint_root(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"


@pytest.mark.parametrize("key", ["grid_rollups", "time_rollups", "grid_live", "upsert_latest", "run_ledger", "sync_upsert", "rebuild_serve", "normalize_sync", "stream_rejects", "due_jobs"])
def test_oracle_agrees_at_sf0001(spark, key):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    want = con.execute(E.oracle_sql()[key]).df()
    got = E.queries()[key](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    norm = lambda pdf: sorted(map(repr, pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False)))
    assert norm(got) == norm(want)


def test_cluster_conf_sizes_partitions():
    from gridpulse.session import cluster_conf

    big = cluster_conf(100 * 10**12, 8000)
    assert big["spark.sql.shuffle.partitions"] == "100000" and big["spark.sql.adaptive.enabled"] == "true"
    small = cluster_conf(10**9, 64)
    assert small["spark.sql.shuffle.partitions"] == "128"
