"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls
back to character 4-grams (with its edges), those to 3-grams and so on; the
longest length of which the model knows any n-gram decides. A text's language
has the highest sum over its words; the score is its posterior share.

The model is learned on at most ``train_rows`` documents and ``train_bytes`` bytes
of each language (one document at least), so it is bounded and can be sent to every
task. They are chosen by hash of their id, those of over ``short_bytes`` only where a
language has too few others; a chosen text is learned whole. Counts are made in
Spark; words and n-grams seen once are left out.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as are all when nothing could be learned; ties go to the language with more
training words, then to the first by name; repeated rows are predicted one by
one; columns other than ``doc_id``, ``text`` and (for training) ``lang`` are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shredline.llm.common import counter_index, number, remainder

LONGEST = 4
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; numerals that aren't digits are no letters either."""
    out = []
    for run in _WORD.findall(text.lower()) if text else []:
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between edge marks."""
    edged = f" {word} " if n > 1 else word
    return [edged[i:i + n] for i in range(max(0, len(edged) - n + 1))]


class BackoffModel:
    """Log frequencies: ``tables[0]`` by word, ``tables[n]`` by character n-gram; one column for each language."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]], smooth: float = 0.5):
        self.langs = langs
        column = {lang: i for i, lang in enumerate(langs)}
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        counts: list[list] = [[] for _ in range(LONGEST + 1)]
        for lang, n, item, count in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            at = self.tables[n].setdefault(item, len(self.tables[n]))
            counts[n].append((at, column[lang], count))
        self.logs = []
        for table, got in zip(self.tables, counts):
            m = np.full((len(table), len(langs)), smooth)
            for i, j, c in got:
                m[i, j] += c
            self.logs.append(np.log(m / m.sum(axis=0)) if len(table) else m)
        words = Counter()
        for lang, n, _, count in rows:
            if n == 0:
                words[lang] += count
        self.prior = np.array([words[lang] for lang in langs], dtype=float)

    def word(self, word: str) -> np.ndarray:
        at = self.tables[0].get(word)
        if at is not None:
            return self.logs[0][at]
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            own = [table[g] for g in grams(word, n) if g in table]
            if own:
                return self.logs[n][own].mean(axis=0)
        return np.zeros(len(self.langs))

    def best(self, total: np.ndarray) -> tuple[str, float]:
        top = max(range(len(self.langs)), key=lambda j: (total[j], self.prior[j], -j))
        return self.langs[top], float(1.0 / np.exp(np.minimum(total - total[top], 0.0)).sum())


def fit(docs: DataFrame, hold_mod: int = 4, hold_rest: int = 2, train_rows: int = 600, train_bytes: int = 8 << 20,
        short_bytes: int = 64 << 10) -> BackoffModel:
    """The model from a bounded sample of the rows that are not held out."""
    learn = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("key"), F.octet_length("text").alias("size")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), hold_mod) != hold_rest))
    first = Window.partitionBy("lang").orderBy(F.col("size") > short_bytes, F.xxhash64("doc_id"), "doc_id", "key")
    own = (learn.select("doc_id", "lang", "key", "size").withColumn("at", F.row_number().over(first))
           .where(F.col("at") <= train_rows).withColumn("upto", F.sum("size").over(first))
           .where((F.col("at") == 1) | (F.col("upto") <= train_bytes)).select("doc_id", "lang", "key"))
    # At most train_rows rows of each language; rows that are wholly equal are learned once.
    sample = (learn.join(F.broadcast(own), ["doc_id", "lang", "key"], "left_semi").dropDuplicates(["doc_id", "lang", "key"])
              .select("doc_id", "text", "lang"))

    def count(batches):
        words: Counter = Counter()

        def batch():
            found: Counter = Counter()
            for (lang, word), times in words.items():
                found[lang, 0, word] += times
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        found[lang, n, g] += times
            words.clear()
            keys = list(found)
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())],
                names=["lang", "n", "item", "count"])

        for part in batches:
            for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words.update((lang, w) for w in words_of(text))
                if len(words) > 100_000:
                    yield batch()
        if words:
            yield batch()

    counted = (sample.mapInArrow(count, "lang string, n int, item string, count long")
               .groupBy("lang", "n", "item").agg(F.sum("count").alias("count")))
    rows = [tuple(r) for r in counted.where("count > 1 or n = 1").collect()]     # bounded by the sample
    return BackoffModel(sorted({r[0] for r in rows}), rows)


def predict(docs: DataFrame, model: BackoffModel, keep: int = 200_000) -> DataFrame:
    """doc_id, lang_pred, score of every row; a task keeps the scores of at most ``keep`` words before it starts afresh."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        index, scores = counter_index(), np.empty((0, len(model.langs)))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                if len(index) > keep:
                    index, scores = counter_index(), np.empty((0, len(model.langs)))
                parts = [number(index, words_of(t)) for t in part.column(1).to_pylist()]
                if model.langs and len(index) > len(scores):
                    new = list(index)[len(scores):]
                    scores = np.concatenate([scores, np.array([model.word(w) for w in new])])
                got = [model.best(scores[p].sum(axis=0)) if len(p) and model.langs else ("und", 0.0) for p in parts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()),
                                                  pa.array([g[1] for g in got], pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, hold_mod: int = 4, hold_rest: int = 2, train_rows: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    found = predict(docs, fit(docs, hold_mod, hold_rest, train_rows))
    return found.select("doc_id", (remainder(F.col("doc_id"), hold_mod) == hold_rest).alias("held_out"),
                        "lang_pred", "score")

