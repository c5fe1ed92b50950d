"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public byte-level vocabulary. The probability of a
word is the sum, over every way to cut it into pieces, of the product of their probabilities; the forward
algorithm gives that sum in time linear in the word. A text's score for a language is the product over its
words, and the prediction is the language of the largest posterior under equal priors.

Learning is expectation maximisation over the same lattice: expected piece counts by forward-backward in
Spark tasks, summed by language and piece, a few rounds from uniform. It uses only the texts and non-null
languages of rows that are not held out, and of those a hash sample of about ``docs_per_lang`` documents a
language (a documented bound; it draws from the whole table). Prediction reads the whole text and nothing else.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if
there is nothing to learn from. A null id is not held out. Words are runs of letters and the marks on them, in
lower case, however long; sums that a double could not hold are taken in logarithms. Of equally likely languages the first
in alphabetical order is given. Repeated rows each get their row; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import pickle
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import workers
from searchloom.llm.common import Scratch, unused
from searchloom.llm.tokenizer import resolve

#: Words of more bytes are scored one by one, in logarithms, shorter ones together by length; the sums are the same.
LONG_WORD = 64
#: Characters of a text that are cut into words at a time.
SECTION = 1 << 20
#: Entries and bytes of a worker's table of words that it has scored; when full it is set aside, in place of the one set aside
#: before, and words in that are taken over as they are met. Longer words aren't entered.
TABLE_ENTRIES, TABLE_BYTES, LONGEST_KEPT = 100_000, 32 << 20, 64
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
HASH_BASE, HASH_MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
HASH_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def words_of(text: str) -> list[str]:
    """Runs of letters and the marks on them, in lower case."""
    return LETTERS.findall(text.lower())


def sections(text: str) -> Iterator[str]:
    """A long text in parts that end at white space."""
    at = 0
    while len(text) - at > SECTION:
        end = at + SECTION
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class Pieces:
    """The vocabulary: which byte strings are pieces. Lookup by 64-bit hash in an open table."""

    def __init__(self, vocabulary: str):
        with open(resolve(vocabulary), "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        self.pieces = [p for p in pieces if p]
        self.n = len(self.pieces)
        if len({p for p in self.pieces if len(p) == 1}) < 256:
            raise ValueError("the vocabulary lacks single bytes: not every word can be cut into pieces")
        self.lengths = sorted({len(p) for p in self.pieces})
        bits = max(8, (8 * self.n).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.ids = np.zeros((1 << bits) + 64, np.uint64), np.full((1 << bits) + 64, self.n, np.int32)
        self.depth = 0
        with np.errstate(over="ignore"):
            for i, p in enumerate(self.pieces):
                h = np.uint64(1)
                for c in p:
                    h = h * HASH_BASE + np.uint64(c + 1)
                at = int((h * HASH_MIX) >> self.shift)
                d = 0
                while self.keys[at + d]:
                    d += 1
                self.keys[at + d], self.ids[at + d] = h, i
                self.depth = max(self.depth, d)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = ((h * HASH_MIX) >> self.shift).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.ids[at], self.n)
        left = np.flatnonzero((key != h) & (key != 0))
        at, h = at[left], h[left]
        for _ in range(self.depth):
            if not len(left):
                break
            at = at + 1
            key = self.keys[at]
            same = key == h
            out[left[same]] = self.ids[at[same]]
            on = ~same & (key != 0)
            left, at, h = left[on], at[on], h[on]
        return out

    def lattice(self, letters: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(begin, end) -> piece of each word, ``n`` where the bytes there are none. Words of one length, as rows."""
        m = letters.shape[1]
        have = set(self.lengths)
        out = {}
        for i in range(m):
            h = np.ones(len(letters), np.uint64)
            for j in range(i + 1, min(m, i + self.lengths[-1]) + 1):
                h = h * HASH_BASE + (letters[:, j - 1] + np.uint64(1))
                if j - i in have:
                    out[i, j] = self.find(h)
        return out

    def arcs(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends, pieces) of all pieces in one word, by end."""
        x = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        up, down = np.full(len(x) + 1, HASH_BASE), np.full(len(x) + 1, HASH_INVERSE)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        c = np.concatenate([[np.uint64(0)], np.cumsum(x * down[:-1])])
        begins, ids, ends = [], [], []
        for n in self.lengths:
            if n > len(x):
                break
            i = np.arange(len(x) - n + 1)
            found = self.find(up[n] + (c[n:] - c[:-n]) * up[i + n - 1])
            at = np.flatnonzero(found < self.n)
            begins.append(at)
            ends.append(at + n)
            ids.append(found[at])
        begins, ends, ids = (np.concatenate(v) for v in (begins, ends, ids))
        order = np.argsort(ends, kind="stable")
        return begins[order], ends[order], ids[order]


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, their bytes as rows) for each length, some thousands at a time."""
    at = defaultdict(list)
    for k, w in enumerate(words):
        at[len(w)].append(k)
    for m, ks in at.items():
        for s in range(0, len(ks), 8192):
            part = ks[s : s + 8192]
            yield np.array(part), np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), m).astype(np.uint64)


def together(p: np.ndarray) -> int:
    """Longest words in bytes that are scored together by length: no product of their pieces' probabilities vanishes in a double."""
    return int(min(LONG_WORD, 290 / max(1.0, -np.log10(p[:-1].min(initial=1.0)))))


def forward(lattice: dict, m: int, p: np.ndarray, n: int) -> list[np.ndarray]:
    """f[j]: probability of the first j bytes, for each word and column of p, which has a last row of zeros."""
    f, into = [np.ones((n, p.shape[1]))], defaultdict(list)
    for i, j in lattice:
        into[j].append(i)
    for j in range(1, m + 1):
        f.append(sum(f[i] * p[lattice[i, j]] for i in into[j]))
    return f


def backward(lattice: dict, m: int, p: np.ndarray, n: int) -> list[np.ndarray]:
    """The same for the bytes from i on."""
    b, out_of = [np.ones((n, p.shape[1]))] * (m + 1), defaultdict(list)
    for i, j in lattice:
        out_of[i].append(j)
    for i in range(m - 1, -1, -1):
        b[i] = sum(b[j] * p[lattice[i, j]] for j in out_of[i])
    return b


def along(begins: np.ndarray, ends: np.ndarray, logs: np.ndarray, m: int) -> np.ndarray:
    """Logarithms of the forward sums of one word over its arcs, which come by end; ``logs``: of the arcs' probabilities."""
    f = np.zeros((m + 1, logs.shape[1]))
    cut = np.searchsorted(ends, np.arange(m + 2))
    for j in range(1, m + 1):
        x = f[begins[cut[j] : cut[j + 1]]] + logs[cut[j] : cut[j + 1]]
        top = x.max(0)
        f[j] = top + np.log(np.exp(x - top).sum(0))
    return f


def expected(vocab: Pieces, words: list[bytes], lang: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of each piece in each language, over all segmentations of the words, each in its own language."""
    total, most = np.zeros(p.shape), together(p)
    short = [k for k, w in enumerate(words) if len(w) <= most]
    for at, letters in by_length([words[k] for k in short]):
        at = np.array(short)[at]
        lat, m = vocab.lattice(letters), letters.shape[1]
        for of in np.unique(lang[at]):
            own = lang[at] == of
            part, col, n = {ij: q[own] for ij, q in lat.items()}, p[:, of : of + 1], int(own.sum())
            f, b = forward(part, m, col, n), backward(part, m, col, n)
            for (i, j), q in part.items():
                np.add.at(total, (q, of), weight[at][own] * (f[i] * col[q] * b[j] / f[m])[:, 0])
    for k, w in enumerate(words):
        if len(w) > most:
            m, of = len(w), lang[k]
            begins, ends, ids = vocab.arcs(w)
            logs = np.log(p[ids, of])[:, None]
            turned = np.argsort(m - begins, kind="stable")
            f, b = along(begins, ends, logs, m), along((m - ends)[turned], (m - begins)[turned], logs[turned], m)[::-1]
            np.add.at(total, (ids, of), weight[k] * np.exp(f[begins] + logs + b[ends] - f[m])[:, 0])
    return total


def encoded(word: str) -> bytes:
    return (" " + word).encode("utf-8", "surrogatepass")


#: The step's name among what a worker keeps.
STEP = "language_id"


def pieces(vocabulary: str) -> Pieces:
    """One vocabulary per worker process."""
    return workers.kept(STEP, vocabulary, lambda: Pieces(vocabulary))


class Model:
    """Learned piece probabilities; what a worker holds to score texts."""

    def __init__(self, langs: list[str], p: np.ndarray, vocabulary: str):
        self.langs, self.p, self.vocabulary = langs, p, vocabulary
        self._start()

    def __getstate__(self) -> tuple:
        return self.langs, self.p, self.vocabulary

    def __setstate__(self, state: tuple) -> None:
        self.langs, self.p, self.vocabulary = state
        self._start()

    def _start(self) -> None:
        width = max(1, len(self.langs))
        self.together = together(self.p)
        self.capacity = max(1000, min(TABLE_ENTRIES, TABLE_BYTES // (8 * width)))
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))
        self.aside = self.row, self.table

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        raw = [encoded(w) for w in words]
        out = np.zeros((len(words), len(self.langs)))
        vocab = pieces(self.vocabulary)
        short = [k for k, w in enumerate(raw) if len(w) <= self.together]
        for at, letters in by_length([raw[k] for k in short]):
            m = letters.shape[1]
            out[np.array(short)[at]] = np.log(forward(vocab.lattice(letters), m, self.p, len(at))[m])
        for k, w in enumerate(raw):
            if len(w) > self.together:
                begins, ends, ids = vocab.arcs(w)
                out[k] = along(begins, ends, np.log(self.p[ids]), len(w))[-1]
        return out

    def _enter(self, texts: list[str]) -> list[list[str]]:
        """The words of some texts, all but very long ones entered in the table with their scores."""
        cut = [words_of(t) for t in texts]
        every = {w for w in set().union(*cut) if len(w) <= LONGEST_KEPT}
        new = every.difference(self.row)
        if new and len(self.row) + len(new) > self.capacity:
            self.aside = self.row, self.table
            self.row, self.table = {}, self.table[:0]
            new = every
        if new:
            known, scores = self.aside
            met = [w for w in new if w in known]
            unmet = list(new.difference(known))
            begin, middle, end = len(self.row), len(self.row) + len(met), len(self.row) + len(new)
            if end > len(self.table):
                grown = np.zeros((max(end, 2 * len(self.table)), len(self.langs)))
                grown[:begin] = self.table[:begin]
                self.table = grown
            self.table[begin:middle] = scores[[known[w] for w in met]]
            self.table[middle:end] = self.word_scores(unmet)
            self.row.update(zip(met + unmet, range(begin, end)))
        return cut

    def _sum(self, words: list[str]) -> np.ndarray:
        """Sum of the scores of words, and how many they are."""
        out = np.zeros(len(self.langs) + 1)
        out[-1] = len(words)
        kept = words
        odd = [w for w in words if len(w) > LONGEST_KEPT]
        if odd:
            out[:-1] += self.word_scores(odd).sum(0)
            kept = [w for w in words if len(w) <= LONGEST_KEPT]
        if kept:
            out[:-1] += self.table[np.fromiter(map(self.row.__getitem__, kept), np.int64, len(kept))].sum(0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums = np.zeros((len(texts), len(self.langs) + 1))
        short = [k for k, t in enumerate(texts) if t and len(t) <= SECTION]
        for k, words in zip(short, self._enter([texts[k] for k in short])):  # their words are scored together
            sums[k] = self._sum(words)
        for k, t in enumerate(texts):
            if t and len(t) > SECTION:
                for section in sections(t):
                    sums[k] += self._sum(self._enter([section])[0])
        logs = sums[:, :-1]
        best = logs.argmax(1)
        score = 1 / np.exp(np.maximum(logs - logs.max(1, keepdims=True), -700)).sum(1)
        known = sums[:, -1] > 0
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0)


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    df: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", docs_per_lang: int = 1500, rounds: int = 4, smoothing: float = 0.01,
    most_langs: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Learn from the rows of ``df`` that have a language and are not held out. More than ``most_langs`` languages are an
    error: the model, a number for each piece and language, is held by every worker."""
    spark = df.sparkSession
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1, 0)), vocabulary)
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_lang / sizes[lang]))])
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin(STEP)
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for part in sections(text.as_py()):
                    seen.update((lang, w) for w in words_of(part))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "word", "n"])
        workers.give_back()

    scratch = Scratch(spark, "language-id")
    words = scratch.write(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    vocab = pieces(vocabulary)
    p = np.full((vocab.n + 1, len(langs)), 1.0 / vocab.n)
    p[-1] = 0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocab, p = pieces(vocabulary), sent.value
            total = np.zeros(p.shape)
            for b in batches:
                lang = np.array([langs.index(x) for x in b.column(0).to_pylist()])
                total += expected(vocab, [encoded(w) for w in b.column(1).to_pylist()], lang, b.column(2).to_numpy(), p)
            q, k = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(k, pa.int32()), pa.array(total[q, k])], ["piece", "lang", "c"])

        # at most one row for each piece and language comes back
        got = words.mapInArrow(expect, "piece int, lang int, c double").groupBy("piece", "lang").agg(F.sum("c").alias("c")).toPandas()
        c = np.full((vocab.n, len(langs)), smoothing)
        c[got["piece"], got["lang"]] += got["c"]
        p = np.vstack([c / c.sum(0), np.zeros(len(langs))])
        sent.destroy()
    scratch.drop(words)
    return Model(langs, p, vocabulary)


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function text -> struct(lang_pred, score)."""
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    key = uuid.uuid4().hex

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = workers.kept(STEP, Model, lambda: pickle.loads(sent.value), key)  # one model at a time
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            lang, score = [], []
            for s in range(0, len(texts), 512):
                a, b = own.predict(texts[s : s + 512])
                lang += a
                score += b.tolist()
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        workers.give_back()

    return F.pandas_udf(predict, "lang_pred string, score double")


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    guess = predictor(df.sparkSession, model)
    rows = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), guess(F.col(text_col).cast("string")).alias("g"))
    return rows.select("doc_id", "held_out", "g.lang_pred", "g.score")


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose language is known with a posterior of ``least`` or more."""
    guess = predictor(df.sparkSession, model)
    (g,) = unused(df, "guess")
    marked = df.withColumn(g, guess(F.col(text_col).cast("string")))
    return marked.where((F.col(f"{g}.lang_pred") != "und") & (F.col(f"{g}.score") >= least)).drop(g)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
