"""Mixing sources to target weights, with built-in functions only.

Weights are the sources' token shares raised to an exponent and normalised. The exponent is found by
bisection so that the mixture has a target entropy, and moved on, if need be, until no source is repeated
more often than a limit. Each step of the search evaluates many exponents in one aggregation over the
per-source table, so any number of sources will do and only one number per exponent comes back.

The weights are realised under a token budget as block permutations: a source's documents fall by hash into
``blocks`` blocks; each epoch orders the blocks by a permutation of its own; a source takes as many whole
epochs as its share of the budget holds, and of the next one the documents that still fit, in order. Prefix
sums are taken over a source's blocks and within each block, never over a source; the number of blocks follows
the square root of the number of documents (at least 4096), so neither sum grows with the corpus itself.

Tokens of a document are its words (between ASCII white space) and one end mark. Defined results: null text
counts as empty (one token), a null source as ''; rows that share id and source are one document of all
their tokens; null ids are one document a source; an empty table gives an empty result. Sources of weight
too small for a document give no row. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchloom.llm.common import Scratch, clean_text, unused

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS = 4096
POINTS, ROUNDS = 63, 9


def _hash48(*parts: Column | str) -> Column:
    """A number below 2**48 from the MD5 of the parts, joined by colons; other engines can compute it too."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols).cast("binary")), 1, 12), 16, 10).cast("long")


def _search(values: DataFrame, measure: Column, good, low: float, high: float) -> float:
    """The smallest exponent x between ``low`` and ``high`` whose measure is ``good``; goodness is monotone in x."""
    for _ in range(ROUNDS):
        step = (high - low) / (POINTS + 1)
        points = [low + step * k for k in range(1, POINTS + 1)]
        got = values.select(F.explode(F.array(*[F.lit(x) for x in points])).alias("x"), "*").groupBy("x").agg(measure.alias("m")).collect()
        fine = sorted(r["x"] for r in got if good(r["m"]))
        high = fine[0] if fine else high
        low = max([low, *[x for x in points if x < high]])
    return high


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float, budget: float) -> float:
    """The exponent for ``sources(source, tokens, share)``."""
    p, x = F.col("share"), F.col("x")
    z, s = F.sum(F.pow(p, x)), F.sum(F.pow(p, x) * F.ln(p))
    entropy = F.ln(z) - x * s / z
    one = lambda c, at: sources.withColumn("x", F.lit(at)).groupBy("x").agg(c.alias("m")).first()["m"]
    natural, flat = one(entropy, 1.0), math.log(one(F.count(F.lit(1)), 1.0))
    target = natural + 0.5 * (flat - natural) if target_entropy is None else target_entropy
    alpha = 0.0 if flat <= target else _search(sources, entropy, lambda m: m <= target, 0.0, 1.0) if natural < target else 1.0
    # repeats of the most repeated source: budget * weight / tokens
    repeats = F.max(F.pow(p, x) / F.col("tokens")) * budget / z
    if one(repeats, alpha) > max_repeats:
        alpha = _search(sources, repeats, lambda m: m <= max_repeats, alpha, 1.0)
    return alpha


def block_count(n: int) -> int:
    """Blocks of ``n`` documents: neither a source's blocks nor a block's documents are many more than the square root of ``n``."""
    return max(BLOCKS, 1 << math.ceil(math.log2(math.sqrt(max(1, n)))))


class _Plan:
    """Documents in blocks, and what each source gives: ``whole`` epochs and ``rest`` tokens of the next one."""

    def __init__(self, df: DataFrame, target_entropy: float | None, max_repeats: float, budget: int | None, seed: str, id_col: str, text_col: str, source_col: str, blocks: int | None):
        self.scratch, self.seed = Scratch(df.sparkSession, "mix"), seed
        rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), (F.regexp_count(clean_text(F.col(text_col)), F.lit(WORD)) + 1).cast("long").alias("n"))
        docs = self.scratch.write(rows.groupBy("doc_id", "source").agg(F.sum("n").alias("n_tokens")).withColumn("u", _hash48(seed, F.col("doc_id"))), "documents")
        self.blocks = blocks or block_count(docs.count())
        self.docs = docs.withColumn("block", self.block(F.col("u")))
        self.by_block = self.scratch.write(self.docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
        per_source = self.by_block.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        total = per_source.agg(F.sum("tokens")).first()[0]
        self.empty = not total
        if self.empty:
            return
        budget = total if budget is None else budget
        sources = self.scratch.write(per_source.withColumn("share", F.col("tokens") / F.lit(float(total))), "sources")
        alpha = find_exponent(sources, target_entropy, max_repeats, float(budget))
        z = sources.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0]
        quota = F.floor(F.pow("share", F.lit(alpha)) / F.lit(z) * F.lit(float(budget)) + F.lit(1e-6)).cast("long")
        self.quotas = sources.select("source", quota.alias("quota"), "tokens").select("source", F.expr("quota div tokens").cast("int").alias("whole"), F.expr("quota % tokens").alias("rest"))

    def block(self, u: Column) -> Column:
        return F.pmod(u, F.lit(self.blocks)).cast("int")

    def place(self, epoch: Column, block: Column) -> Column:
        """What orders the blocks of an epoch."""
        return _hash48(self.seed, epoch, block)

    def ordered(self, epochs: DataFrame) -> DataFrame:
        """The blocks of ``epochs(source, epoch, ...)`` in their order, ``before``: tokens of the epoch in the blocks before."""
        order = Window.partitionBy("source", "epoch").orderBy("place", "block")
        return self.by_block.join(epochs, "source").withColumn("place", self.place(F.col("epoch"), F.col("block"))).withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))

    def cuts(self) -> DataFrame:
        """One row a source: ``whole``, and where the epoch after the whole ones ends: a document is in it if its (place, block, u, doc_id) is at
        most (c_place, c_block, c_u, c_id). Both the blocks of an epoch and the documents of a block are taken from the front, so one bound says all."""
        last = self.ordered(self.quotas.select("source", "rest", "whole", F.col("whole").alias("epoch"))).where("before < rest")
        end = last.groupBy("source").agg(F.max(F.struct("place", "block", "before", "tokens", "rest")).alias("e")).select("source", "e.*")
        split = end.where("before + tokens > rest").select(F.col("source").alias("s"), F.col("block").alias("b"), "before", "rest")
        inside = Window.partitionBy("source", "block").orderBy("u", "doc_id")
        within = self.docs.join(split, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b"))).withColumn("upto", F.sum("n_tokens").over(inside))
        fits = within.where("before + upto <= rest").groupBy("source").agg(F.max(F.struct("upto", "u", "doc_id")).alias("d")).select(F.col("source").alias("s"), F.col("d.u").alias("d_u"), F.col("d.doc_id").alias("c_id"))
        ends = end.join(fits, F.col("source") == F.col("s"), "left").select(
            F.col("source").alias("e_source"), F.col("place").alias("c_place"), F.col("block").alias("c_block"), "c_id",
            F.when(F.col("before") + F.col("tokens") <= F.col("rest"), F.lit(1 << 48)).otherwise(F.coalesce("d_u", F.lit(-1))).cast("long").alias("c_u"),
        )
        return self.scratch.write(self.quotas.select("source", "whole").join(ends, F.col("source") == F.col("e_source"), "left").drop("e_source"), "cuts")


def mix(
    df: DataFrame, target_entropy: float | None = None, max_repeats: float = 4.0, budget: int | None = None, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int | None = None,
) -> DataFrame:
    """One row per document and epoch in which it is taken: doc_id, source, n_tokens, epoch, block, position.

    ``position`` is the tokens of its source's epoch that come before it. ``budget``: total tokens of the
    mixture, the corpus's own number if not given. ``target_entropy`` in nats; if not given, half-way between
    the natural mixture's and the flat one's.
    """
    p = _Plan(df, target_entropy, max_repeats, budget, seed, id_col, text_col, source_col, blocks)
    if p.empty:
        return p.docs.select("doc_id", "source", "n_tokens", F.lit(0).alias("epoch"), "block", F.lit(0).cast("long").alias("position"))
    epochs = p.quotas.select("source", "rest", "whole", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("epoch"))
    ordered = (
        p.ordered(epochs).where((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("rest")))
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "before", F.when(F.col("epoch") < F.col("whole"), F.lit(None).cast("long")).otherwise(F.col("rest")).alias("until"))
    )
    within = Window.partitionBy("source", "block").orderBy("u", "doc_id")
    placed = p.docs.withColumn("inside", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    taken = placed.join(ordered, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b"))).withColumn("position", F.col("before") + F.col("inside"))
    return taken.where(F.col("until").isNull() | (F.col("position") + F.col("n_tokens") <= F.col("until"))).select("doc_id", "source", "n_tokens", "epoch", "block", "position")


def take_mixture(
    df: DataFrame, target_entropy: float | None = None, max_repeats: float = 4.0, budget: int | None = None, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int | None = None,
) -> DataFrame:
    """The rows of ``df``, with all their columns, each as often as the mixture takes it.

    Texts are not shuffled: each row is compared with its source's cut, one row a source.
    """
    p = _Plan(df, target_entropy, max_repeats, budget, seed, id_col, text_col, source_col, blocks)
    if p.empty:
        return df.limit(0)
    names = ["source", "whole", "c_place", "c_block", "c_u", "c_id", "u", "block", "place", "times"]
    own = dict(zip(names, unused(df, *[f"mix_{n}" for n in names])))
    c = lambda n: F.col(own[n])
    cuts = p.cuts().select(*[F.col(n).alias(own[n]) for n in names[:6]])
    rows = df.withColumn(own["u"], _hash48(seed, F.col(id_col))).withColumn(own["block"], p.block(c("u")))
    rows = rows.join(cuts, F.coalesce(F.col(source_col).cast("string"), F.lit("")) == c("source")).withColumn(own["place"], p.place(c("whole"), c("block")))
    upto = F.col(id_col).isNull() | F.coalesce(F.col(id_col) <= c("c_id"), F.lit(False))
    inside = (c("u") < c("c_u")) | ((c("u") == c("c_u")) & upto)
    taken = (c("place") < c("c_place")) | ((c("place") == c("c_place")) & ((c("block") < c("c_block")) | ((c("block") == c("c_block")) & inside)))
    rows = rows.withColumn(own["times"], c("whole") + F.coalesce(taken, F.lit(False)).cast("int")).where(c("times") > 0)
    return rows.select(*df.columns, F.explode(F.sequence(F.lit(1), c("times"))).alias(own["times"])).drop(own["times"])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n FROM documents),
docs AS (
  SELECT *, CAST(u % greatest(4096, CAST(pow(2, ceil(log2(sqrt(count(*) OVER ())))) AS BIGINT)) AS INTEGER) AS block FROM (
    SELECT doc_id, source, CAST(sum(n) AS BIGINT) AS n_tokens, CAST('0x' || substr(md5('mix:' || doc_id), 1, 12) AS BIGINT) AS u FROM rows GROUP BY doc_id, source)),
src AS (
  SELECT source, tokens, tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS share, CAST(sum(tokens) OVER () AS DOUBLE) AS budget
  FROM (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY source)),
arr AS (SELECT list(share) AS p, list(tokens) AS t, any_value(budget) AS budget FROM src),
aim AS (SELECT *, -list_sum(list_transform(p, lambda v: v * ln(v))) AS h_own, ln(len(p)) AS h_flat FROM arr),
b1(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN h <= (h_own + h_flat) / 2 THEN lo ELSE x END, CASE WHEN h <= (h_own + h_flat) / 2 THEN x ELSE hi END FROM (
    SELECT i, lo, hi, x, h_own, h_flat, ln(list_sum(list_transform(p, lambda v: pow(v, x)))) - x * list_sum(list_transform(p, lambda v: pow(v, x) * ln(v))) / list_sum(list_transform(p, lambda v: pow(v, x))) AS h
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS x FROM b1 WHERE i < 54), aim)),
a1 AS (SELECT hi AS alpha FROM b1 WHERE i = 54),
b2(i, lo, hi) AS (
  SELECT 0, alpha, CAST(1 AS DOUBLE) FROM a1
  UNION ALL
  SELECT i + 1, CASE WHEN r <= 4 THEN lo ELSE x END, CASE WHEN r <= 4 THEN x ELSE hi END FROM (
    SELECT i, lo, hi, x, list_max(list_transform(range(1, len(p) + 1), lambda k: pow(p[k], x) / t[k])) * budget / list_sum(list_transform(p, lambda v: pow(v, x))) AS r
    FROM (SELECT i, lo, hi, CASE WHEN i = 0 THEN lo ELSE (lo + hi) / 2 END AS x FROM b2 WHERE i < 55), aim)),
alpha AS (SELECT CASE WHEN (SELECT hi FROM b2 WHERE i = 1) = (SELECT alpha FROM a1) THEN (SELECT alpha FROM a1) ELSE (SELECT hi FROM b2 WHERE i = 55) END AS alpha),
plan AS (
  SELECT source, quota // tokens AS whole, quota % tokens AS rest FROM (
    SELECT source, tokens, CAST(floor(pow(share, alpha) / sum(pow(share, alpha)) OVER () * budget + 1e-6) AS BIGINT) AS quota FROM src, alpha)),
epochs AS (SELECT source, whole, rest, CAST(unnest(range(0, whole + 1)) AS INTEGER) AS epoch FROM plan),
blk AS (SELECT source, block, sum(n_tokens) AS tokens FROM docs GROUP BY source, block),
ordered AS (
  SELECT source, block, epoch, whole, rest, CAST(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY place, block) - tokens AS BIGINT) AS before
  FROM (SELECT *, CAST('0x' || substr(md5('mix:' || epoch || ':' || block), 1, 12) AS BIGINT) AS place FROM blk JOIN epochs USING (source))),
placed AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY u, doc_id) - n_tokens AS BIGINT) AS inside FROM docs)
SELECT doc_id, source, n_tokens, epoch, block, before + inside AS position
FROM placed JOIN ordered USING (source, block)
WHERE epoch < whole OR before + inside + n_tokens <= rest
"""
