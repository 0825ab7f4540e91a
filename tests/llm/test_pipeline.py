"""The pipeline's stages, each against what it must do to its own input."""

import re

import pytest

import corpus_pipeline
from quarrylight.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.toPandas()
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["documents", "quality_rules", "line_dedup", "minhash_dedup", "decontamination", "bpe_codec"]
    assert all(list(stages[k].columns) == COLUMNS for k in list(stages)[:-1])
    assert list(stages["bpe_codec"].columns) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_drops_junk_only(stages):
    kept = set(stages["quality_rules"].doc_id)
    for r in stages["documents"].itertuples():
        if len(r.text.split()) < 20:
            assert r.doc_id not in kept


def test_lines_are_unique_across_documents(stages):
    seen: dict[str, int] = {}
    for r in stages["line_dedup"].itertuples():
        assert r.n_chars == len(r.text)
        for key in {x.strip().lower() for x in r.text.split("\n")}:
            if len(key) >= 10 and key.isascii():
                assert seen.setdefault(key, r.doc_id) == r.doc_id


def test_no_near_copies_and_no_leaks(stages, spark):
    sets = {}
    for r in stages["minhash_dedup"].itertuples():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    ids = list(sets)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    bench = set().union(*(grams(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    assert not any(grams(words(t)) & bench for t in stages["decontamination"].text)
    assert set(stages["bpe_codec"].doc_id) == set(stages["decontamination"].doc_id)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(stages["bpe_codec"].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op10_suffix_dedup",)])
def test_queries_match_their_sql(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    if name not in queries.ORACLE_SQL:
        assert found
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    answer = con.execute(queries.ORACLE_SQL[name])
    at = [[x[0] for x in answer.description].index(c) for c in df.columns]
    assert sorted(found, key=str) == sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=str)
