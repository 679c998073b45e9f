import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))
SF = "/root/testdata/sf0.001"

import __spark_entry__ as entry_mod  # noqa: E402
from compare import digest  # noqa: E402

from tuneweave.plans.catalog import registry as library_registry  # noqa: E402
from tuneweave.plans.tables import TABLES  # noqa: E402

QUICK = ["sft_tokens", "exact_split", "adapter_openai_webgpt_comparisons", "pack_blocks",
         "loss_buckets", "gae", "pair_loss", "rank_shards", "sft_cache_from_json", "training_batches",
         "prompt_dataset_phase2_train", "prep_counts", "json_arrays_in_path_order"]


def test_every_query_has_an_oracle():
    assert set(library_registry()) <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["conv_id", "input_ids", "labels", "n_tokens", "n_supervised"]
    assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry_mod.queries()[name](spark, SF)
    res = con.execute(entry_mod.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    srows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
