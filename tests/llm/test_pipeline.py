import hashlib
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from tessera.llm.queries import oracle_sql, queries, vocabulary  # noqa: E402


def test_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    out = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = out, stage(spark, out, small)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            out = out.cache()
            assert 0 < out.count() <= before.count(), name
        if name == "decontaminate":
            assert not any(b in r.text for r in out.collect() for b in bench)
    ids = {r.doc_id for r in out.collect()}
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, small).collect()}


def test_rows_match_brute_force(spark, small):
    """Stage by stage with plain code: lines, near copies, parts of the benchmark, tokens."""
    import corpus_pipeline
    from test_decontaminate import edit_distance_in
    from test_dedup import brute_lines
    from test_minhash import brute

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.language_stage(spark, docs, small).collect()]
    rows = list(brute_lines(rows).items())
    near = brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    plain = lambda t: " ".join(re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", (t or "").lower()).split())
    items = [plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    parts = {p for item in items for k in range(0, max(1, len(item) - 47), 8) if (p := item[k : k + 48])} | {item[-48:] for item in items if item}
    grams = {p[k : k + 8] for p in parts for k in range(len(p) - 7)}

    def held(text):
        text = plain(text)
        some = len({text[k : k + 8] for k in range(len(text) - 7)} & grams) >= 12
        return some and any(edit_distance_in(p, text) <= 3 for p in parts if sum(p[k : k + 8] in text for k in range(len(p) - 7)) >= 17)

    encoding = vocabulary_library()
    want = {}
    for i, t in rows:
        if not held(t):
            ids = np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()
            want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want


def vocabulary_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_stages_take_odd_and_empty_tables(spark, small, odd, empty):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars", "found", "kept", "node", "label", "n_removed"]
    for df in (odd, empty):
        docs = df.withColumns({"lang": F.when(F.col("doc_id") > 3, "en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long"), "node": F.lit(1), "label": F.lit("x"), "n_removed": F.lit(7)}).select(columns)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            rows = out.collect()
            assert out.columns == columns and len(rows) <= docs.count(), name
            if df is odd and name != "language_id":
                assert {None, 1, 2, 3} <= {r.doc_id for r in rows} and {r.n_removed for r in rows} == {7}, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_scratch_is_freed(spark, small):
    import corpus_pipeline

    at = Path(spark.conf.get("spark.checkpoint.dir")) / "tessera" / spark.sparkContext.applicationId
    before = set(at.glob("*")) if at.exists() else set()
    corpus_pipeline.run(spark, small).count()
    assert len(set(at.glob("*")) - before) == 1


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries()[name](spark, small), con.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)
