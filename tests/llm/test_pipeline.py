"""The pipeline, stage by stage, against brute force; the contract of the entry module."""

import re
from collections import Counter

import pytest

from tests.llm.test_near_dup_language import brute
from tests.llm.test_tokens_packing_exact import check_packing


def test_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34 !!", "en", None, 8), (10**6 + 2, "the of and to", None, "src0", 5)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            assert not Counter(set(rows)) - Counter(set(before))
        if name == "language_id":
            gone = set(before) - set(rows)
            assert {r.doc_id for r in gone} == {10**6, 10**6 + 1}
        elif name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
            least = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                least.setdefault(norm(r.text), r)
            assert set(rows) == set(least.values())
        elif name == "near_dedup":
            want = brute([(r.doc_id, r.text) for r in before], 80)
            assert {r.doc_id for r in rows} == {i for i, c in want.items() if i == c} and len(rows) == len(set(rows))
        elif name == "mix_sources":
            count = lambda rs: sum(len(r.text.split()) + 1 for r in rs)
            longest = max(len(r.text.split()) + 1 for r in before)
            assert count(before) - 21 * longest <= count(rows) <= count(before)
            assert max(Counter(rows).values()) <= 5
        else:
            by_id = {}
            for n, r in enumerate(before):
                by_id.setdefault(r.doc_id, []).append(n)
            single = {i for i, n in by_id.items() if len(n) == 1}
            assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in before)
            texts = {r.doc_id: r.text for r in before}
            own = [r for r in rows if r.doc_id in single]
            seqs = Counter()
            for r in rows:
                seqs[r.sequence_id] += r.length
            assert max(seqs.values()) <= 4096
            alone = {r.sequence_id for r in own} - {r.sequence_id for r in rows if r.doc_id not in single}
            part = [r for r in rows if r.sequence_id in alone]
            whole = {i for i in single if all(r.sequence_id in alone for r in own if r.doc_id == i)}
            order = sorted(whole)
            if all(r.doc_id in whole for r in part):
                check_packing([type("R", (), r.asDict() | {"doc_id": order.index(r.doc_id)}) for r in part], [texts[i] for i in order])
        before, docs = rows, out


def test_run_and_entry(spark, sf_dir):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    out = entry.queries()["pipeline"](spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_source_mixing", "op9_license_scan"])
def test_sql(spark, sf_dir, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(tuple(map(str, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    assert key(got) == key(want)
