"""Readers, sinks and incremental indexing over files made here."""

import json
import os

from pyspark.sql import functions as F

from searchloom.operators import index, links, papers, search
from searchloom.sources import readers, writers
from searchloom.streaming import ingest


def paper(pid, **more):
    p = {
        "paper_id": pid, "metadata": {"title": "A study", "authors": [{"first": "An", "middle": ["B"], "last": "Author", "suffix": "", "email": "a@b.c"}]},
        "abstract": [{"text": "short abstract", "section": "Abstract"}], "body_text": [{"text": "body words", "section": "Intro"}], "back_matter": [],
        "bib_entries": {"BIBREF0": {"title": "Other Paper (2nd ed.)", "year": 2001, "other_ids": {}}}, "ref_entries": {"FIGREF0": {"text": "a figure", "type": "figure"}},
    }
    return p | more


def test_papers(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(paper("one")))
    (tmp_path / "2.json").write_text("{ not json")
    (tmp_path / "3.json").write_text(json.dumps(paper("three", metadata={"title": "", "authors": ["Plain Name"]}, abstract=[])))
    (tmp_path / "4.json").write_text(json.dumps({"paper_id": "four"}))
    good, bad = readers.papers(spark, str(tmp_path))
    rows = {r.paper_id: r for r in good.collect()}
    assert set(rows) == {"one", "three", "four"} and [r.file for r in bad.collect()] == ["2.json"]
    assert [a.last for a in rows["three"].metadata.authors] == ["Plain Name"]
    flat = {r.paper_id: r for r in papers.flat(good).collect()}
    assert (flat["one"].authors.split(), flat["one"].bib, flat["one"].ref) == (["An", "Author", "a@b.c"], "Other Paper (2nd ed.)", "a figure")
    assert flat["four"].title == "" and flat["four"].body == ""
    meta = spark.createDataFrame([("three", "Found title")], "id string, title string")
    assert {tuple(r) for r in links.citations(papers.flat(good), meta).collect()} == {("a study", "other paper"), ("found title", "other paper")}
    post = {(r.doc_id, r.word): r for r in index.paper_postings(papers.flat(good)).collect()}
    assert post["Pone", "a"].positions[0] == 0 and post["Pone", "figure"].g3 == 1
    assert papers.compact(good).count() == 3


def test_html_and_maps(spark, tmp_path):
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw" / "10.html").write_text("<p>hello\nworld</p>", encoding="utf-8")
    (tmp_path / "raw" / "11.html").write_text("<p>x</p>")
    (tmp_path / "raw" / "note.txt").write_text("no")
    (tmp_path / "map.json").write_text('{"10": "http://a.com/1"}')
    urls = readers.json_map(spark, str(tmp_path / "map.json")).withColumnsRenamed({"key": "id", "value": "url"})
    got = {r.page_id: r for r in readers.html_files(spark, str(tmp_path / "raw"), urls).collect()}
    assert (got["10"].url, got["11"].url, got["10"].html) == ("http://a.com/1", "", "<p>hello\nworld</p>")
    files = readers.html_files(spark, str(tmp_path / "raw"))
    ids = spark.createDataFrame([("10",), ("99",)], "id string")
    assert [r.id for r in readers.present(ids, files).collect()] == ["10"]


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "e.csv").write_text("from,to\n1 , 2\n3,4\nbad,5\n")
    assert sorted(tuple(r) for r in readers.edges(spark, str(tmp_path / "e.csv")).collect()) == [(1, 2), (3, 4)]
    (tmp_path / "r.csv").write_text("1,0.5\n2,0.25\n")
    assert [r["rank"] for r in readers.ranks(spark, str(tmp_path / "r.csv")).orderBy("id").collect()] == [0.5, 0.25]
    rows = spark.createDataFrame([("http://a", 'say "hi", you'), ("http://b", None)], "url string, t string")
    writers.csv(rows, str(tmp_path / "o"))
    assert sorted(readers.csv(spark, str(tmp_path / "o"), "url string, t string").collect()) == sorted(rows.collect())
    words = spark.createDataFrame([("b", 1), ("a", 0)], "word string, word_id long")
    writers.word_list(words, str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["a", "b"]
    writers.word_list(words, str(tmp_path / "w2"), with_ids=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "w2")).collect()] == ["0 a", "1 b"]
    writers.json(words, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "word string, word_id long").count() == 2
    writers.json_object(words, "word", "word_id", str(tmp_path / "m"))
    assert {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {'{"a":0}', '{"b":1}'}


def test_barrels_prune(spark, tmp_path, sf_dir):
    from searchloom.plans import registry

    postings = index.drop_keys(index.html_postings(registry.pages(spark, sf_dir)), index.HTML_HITS)
    placed = index.barrels(index.barrel_sizes(postings), limit=64 * 1024)
    writers.barrels(postings, placed, str(tmp_path / "b"))
    back = readers.barrels(spark, str(tmp_path / "b"))
    assert back.count() == postings.count() and placed.select("barrel_id").distinct().count() > 1
    queries = spark.createDataFrame([(1, "the and"), (2, "nosuchword")], "qid int, query string")
    found = search.lookup(queries, placed, back)
    assert {r.word for r in found.collect()} == {"the", "and"}
    assert found.count() == postings.where("word in ('the', 'and')").count()
    plan = back.where("barrel_id = 1 and word = 'the'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(barrel_id" in plan and "PushedFilters: [IsNotNull(word), EqualTo(word,the)]" in plan


def test_incremental(spark, tmp_path, sf_dir):
    from searchloom.plans import registry

    pages = registry.pages(spark, sf_dir)
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    pages.where("page_id < 10").write.mode("append").parquet(src)
    ingest.ingest(ingest.page_stream(spark, src), out, ck).awaitTermination()
    pages.where("page_id >= 10 and page_id < 20").union(pages.where("page_id = 3").withColumn("html", F.lit("<p>changed</p>"))).write.mode("append").parquet(src)
    ingest.ingest(ingest.page_stream(spark, src), out, ck).awaitTermination()
    now = ingest.current(spark, out)
    want = index.html_postings(pages.where("page_id < 20 and page_id <> 3"))
    assert now.where("doc_id <> 'H3'").count() == want.count()
    assert {r.word for r in now.where("doc_id = 'H3' and n_total > 0").collect()} == {"changed"}
