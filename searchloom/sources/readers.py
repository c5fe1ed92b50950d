"""Sources. Schemas are given, never inferred; bad records go to a side table, not to failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.tables import dense_ids

_SPAN = "array<struct<start:int,end:int,text:string,ref_id:string>>"
_PARAGRAPHS = f"array<struct<text:string,cite_spans:{_SPAN},ref_spans:{_SPAN},section:string>>"
_NAME = "first:string,middle:array<string>,last:string,suffix:string"
PAPER = (
    f"paper_id string, metadata struct<title:string,authors:array<struct<{_NAME},affiliation:struct<laboratory:string,institution:string,location:map<string,string>>,email:string>>>, "
    f"abstract {_PARAGRAPHS}, body_text {_PARAGRAPHS}, back_matter {_PARAGRAPHS}, "
    f"bib_entries map<string,struct<ref_id:string,title:string,authors:array<struct<{_NAME}>>,year:int,venue:string,volume:string,issn:string,pages:string,other_ids:map<string,array<string>>>>, "
    "ref_entries map<string,struct<text:string,latex:string,type:string>>"
)


def html_files(spark: SparkSession, folder: str, urls: DataFrame | None = None) -> DataFrame:
    """page_id (the file's name without ending), url, html of a folder of .html files; ``urls(id, url)`` gives addresses."""
    files = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    pages = files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.html$", 1).alias("page_id"), F.col("value").alias("html"))
    if urls is None:
        return pages.select("page_id", F.lit("").alias("url"), "html")
    u = urls.select(F.col("id").cast("string").alias("u_id"), "url")
    return pages.join(u, F.col("page_id") == F.col("u_id"), "left").select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html")


def papers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(papers, errors(file, record)): one JSON object a file; files that do not parse are errors.

    The file is read as text and parsed by ``from_json``, so one pass serves both. Authors may be plain strings:
    those are read as last names.
    """
    text = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    plain = F.from_json("value", "metadata struct<title:string,authors:array<string>>")
    parsed = text.withColumn("p", F.from_json("value", f"{PAPER}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("p").isNull() | (F.try_parse_json("value").isNull())
    good = parsed.where(~bad)
    names = F.transform(plain["metadata"]["authors"], lambda a: F.when(~a.startswith("{"), a))
    ids = F.coalesce("p.paper_id", F.regexp_extract("file", r"^(.*)\.json$", 1))
    author_type = dict(spark.createDataFrame([], PAPER).select("metadata.authors").dtypes)["authors"].removeprefix("array<")[:-1]
    as_struct = F.transform(names, lambda a: F.from_json(F.to_json(F.struct(a.alias("last"))), author_type))
    strings = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda a: a.isNotNull())
    authors = F.when(strings, as_struct).otherwise(F.col("p.metadata.authors"))
    title = F.coalesce("p.metadata.title", plain["metadata"]["title"])
    out = good.select(ids.alias("paper_id"), F.struct(title.alias("title"), authors.alias("authors")).alias("metadata"), *[F.col(f"p.{c}") for c in ("abstract", "body_text", "back_matter", "bib_entries", "ref_entries")])
    return out, parsed.where(bad).select("file", F.col("value").alias("record"))


def json_map(spark: SparkSession, path: str, value_type: str = "string", lines: bool = False) -> DataFrame:
    """key, value of one JSON object a file; with ``lines`` one a line, as the sink writes them, read in splits."""
    return spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", f"map<string,{value_type}>")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line: read in splits, however large."""
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').csv(path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of a headed CSV of two whole numbers, spaces around them allowed; other lines are skipped."""
    rows = spark.read.schema("src string, dst string").option("header", True).csv(path)
    return rows.select(F.expr("try_cast(trim(src) as long)").alias("src"), F.expr("try_cast(trim(dst) as long)").alias("dst")).where("src is not null and dst is not null")


def ranks(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, "id long, rank double", header=False)


def barrels(spark: SparkSession, path: str) -> DataFrame:
    """Postings in barrels: a filter on barrel_id prunes folders, one on word prunes row groups."""
    return spark.read.parquet(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, url string, html string").parquet(path)


def words(spark: SparkSession, path: str) -> DataFrame:
    """word of a list of one a line."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def present(ids: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``ids(id)`` whose file is there."""
    return ids.join(files.select(F.col("page_id").cast("string").alias("f")), F.col("id").cast("string") == F.col("f"), "left_semi")


def renumbered(ids: DataFrame, files: DataFrame) -> DataFrame:
    """``ids(id)`` whose file is there, with ``new_id``: dense numbers in the order of the ids."""
    return dense_ids(present(ids, files), [F.col("id")], "new_id")
