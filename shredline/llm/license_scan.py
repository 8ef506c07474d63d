"""License scans by diagonal voting, in DataFrame functions only.

Every rolling 2-word hash of a document is joined to the positions it has in
the notice templates. A match votes for the diagonal ``document position -
template position``; an unchanged notice puts all its votes on one diagonal, and
words added or left out move the rest to a neighbouring one. Votes are summed by
(document, template, diagonal), neighbouring diagonals that continue each other
are merged, and a merged span is verified: the matched words are compared
themselves, enough of the template must be there and the span must not be much
longer than the template.

The template table is broadcast; it is a parameter of at most ``MAX_TEMPLATES``
notices of at most 64 words (split longer notices). Documents are shuffled as
small vote counts only.

Defined results: null and wordless texts have no places and score 0; rows
repeating id and text are counted once and returned as often as they stand;
null ids are returned as such; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_TEMPLATES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java pattern of what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count only when they stand word for word.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Notices that the method finds, changed ones too.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl", "mozilla public license v 2 0"),
]


def lower_ascii(column):
    """Lower-cases A-Z alone; texts without other letters take the fast way."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, UPPER, LOWER))


def template_table(spark, base, notices) -> DataFrame:
    """One row for each 2-word position of each template: w1, w2, template, t_pos, grams, is_base."""
    templates = [(label, text, True) for label, text in base] + [(label, text, False) for label, text in notices]
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates are broadcast")
    rows = []
    for i, (_, text, is_base) in enumerate(templates):
        words = text.split()
        if not 2 <= len(words) <= 64:
            raise ValueError(f"a template has 2 to 64 words: {text!r}")
        rows += [(i, p, len(words) - 1, is_base, words[p], words[p + 1]) for p in range(len(words) - 1)]
    out = spark.createDataFrame(rows, "template int, t_pos int, grams int, is_base boolean, w1 string, w2 string")
    mark = spark.createDataFrame([(-1, 0, 1, False, None, None)], out.schema)       # meets every document once
    return (out.withColumn("gram", F.xxhash64("w1", "w2"))
            .unionByName(mark.withColumn("gram", F.lit(0).cast("long"))))


def diagonal_votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Votes by doc_id, text_hash, template and diagonal; template -1 has one row for each document."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), BETWEEN, -1), "")
    # A generator keeps the optimiser from copying the split into every place that uses its words.
    docs = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(words)).alias("words"))
            .withColumn("grams_here", F.expr(
                "case when size(words) > 1 then transform(sequence(0, size(words) - 2), "
                "i -> xxhash64(words[i], words[i + 1])) else cast(array() as array<bigint>) end"))
            .withColumn("grams_here", F.concat(F.array(F.lit(0).cast("long")), "grams_here"))
            # never empty; the outer form spares a filter that would hash all words once more
            .select("doc_id", "text_hash", "words", F.size("words").alias("n_words"),
                    F.posexplode_outer("grams_here").alias("place", "here")))
    pos = F.col("place") - 1
    return (docs.join(F.broadcast(templates), docs["here"] == templates["gram"])
            .where("(template = -1 and place = 0) or (template >= 0 and words[place - 1] = w1 and words[place] = w2)")
            .select("doc_id", "text_hash", "template", "n_words", "t_pos", "grams", "is_base", pos.alias("pos"),
                    (pos - F.col("t_pos")).alias("diagonal"))
            .groupBy("doc_id", "text_hash", "template", "diagonal")
            .agg(F.max("n_words").alias("n_words"), F.count("*").alias("n_rows"),
                 F.expr("bit_or(shiftleft(1L, t_pos))").alias("votes"),
                 F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("grams").alias("grams"),
                 F.max("is_base").alias("is_base")))


def scan(docs: DataFrame, base=tuple(BASE), notices=tuple(NOTICES), shift: int = 3, share: float = 0.6,
         stretch: float = 1.5) -> DataFrame:
    """License places per document.

    Diagonals at most ``shift`` apart that continue each other are one span;
    it counts when ``share`` of the template's word pairs are in it and it is at
    most ``stretch`` times as long as the template. Returns doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (largest share of a template) and spans
    (label, start, end in words, share) of the counted ones.
    """
    labels = F.array(*[F.lit(label) for label, _ in (*base, *notices)])
    votes = diagonal_votes(docs, template_table(docs.sparkSession, base, notices))
    rows = Window.partitionBy("doc_id", "text_hash").orderBy("template", "first", "diagonal")
    before = F.lag(F.struct("template", "diagonal", "last")).over(rows)
    new = F.coalesce(F.col("is_base") | (F.col("before.template") != F.col("template"))
                     | (F.abs(F.col("diagonal") - F.col("before.diagonal")) > shift)
                     | (F.col("first") > F.col("before.last") + 2 + shift), F.lit(True))
    votes = (votes.withColumn("before", before).withColumn("new", new.cast("int"))
             .withColumn("span", F.sum("new").over(rows.rowsBetween(Window.unboundedPreceding, 0))))
    whole = F.col("is_base") & (F.bit_count("votes") == F.col("grams"))
    spans = (votes.groupBy("doc_id", "text_hash", "template", "span")
             .agg(F.max("n_words").alias("n_words"), F.max("n_rows").alias("n_rows"),
                  F.max("is_base").alias("is_base"), F.max("grams").alias("grams"),
                  F.expr("bit_count(bit_or(votes))").alias("found"), F.min("first").alias("start"),
                  (F.max("last") + 2).alias("end"), F.max(whole).alias("whole"))
             .withColumn("share", F.when(F.col("template") >= 0, F.col("found") / F.col("grams")).otherwise(0.0))
             .withColumn("counts", (F.col("template") >= 0) & F.when(F.col("is_base"), F.col("whole")).otherwise(
                 (F.col("share") >= share)
                 & (F.col("end") - F.col("start") <= F.ceil(F.lit(stretch) * (F.col("grams") + 1))))))
    spans = spans.withColumn("label", F.element_at(labels, F.greatest(F.col("template") + 1, F.lit(1))))
    place = F.when(F.col("is_base") & F.col("counts"), F.col("start")).cast("long")
    label = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    kept = F.when(F.col("counts"), F.struct("label", "start", "end", "share"))
    out = (spans.groupBy("doc_id", "text_hash")
           .agg(F.max("n_words").cast("long").alias("n_words"),
                F.max(F.when(F.col("template") == -1, F.col("n_rows"))).alias("n_rows"),
                F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
                label(F.col("counts") & F.col("is_base")).alias("base_labels"), label(F.col("counts")).alias("labels"),
                F.max("share").alias("score"), F.array_sort(F.collect_list(kept)).alias("spans")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans",
                      F.explode(F.expr("sequence(1L, n_rows)")).alias("_copy")).drop("_copy")
