"""The registered queries on the smallest tables, against SQL where there is some."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from docloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"], "op2": ["query_id", "rank", "vec_id", "score"], "op3": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op4": ["doc_id", "held_out", "lang_pred", "score"],
    "op5": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op6": ["doc_id", "size", "source_size", "target", "taken"], "op7": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op8": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op10": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11": ["doc_id", "n_features", "weight", "score", "rank"], "op12": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op13": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    got = driver.queries()[name](spark, SF)
    assert got.columns[: len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]]
    rows = got.count()
    assert rows == {"op1": 500, "op2": 50}.get(name.split("_")[0], rows) and (rows == 200 or name.split("_")[0] in ("op1", "op2", "op3", "op13"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name, tmp_path):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    driver.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    duck.sql(f"create table want as {queries.ORACLE_SQL[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in duck.sql("describe want").fetchall())
    got = f"(select {columns} from '{tmp_path}/out/*.parquet')"
    assert duck.sql(f"select * from {got} except all select {columns} from want").fetchall() == [] and duck.sql(f"select {columns} from want except all select * from {got}").fetchall() == []
