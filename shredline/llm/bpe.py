"""Byte-level BPE: encoding and decoding with column expressions.

A text is split by the tokenizer's pattern; every match is encoded by itself. A
match that is a token is that token. Any other starts as its bytes, and a fold
joins, as long as some neighbours together are a token, the leftmost pair of the
lowest rank. Tokens are written as single characters in the order of their ranks,
so the pieces of a word are a string, and a second string holds the token that
each pair would make: its least character is the next merge, which looks up two
new pairs only. Ranks come from a literal: an array of small maps that XXH64 of
the key indexes, so that a lookup costs the same for any vocabulary.

Every distinct word is folded once if it is among the ``dictionary`` most frequent
(of at most ``WORD_BYTES`` bytes, twice at least): their ids become a second literal
of bounded size, together with the tokens themselves. The words beyond it are
folded where they stand, so nothing depends on the dictionary but the time, and
documents are never shuffled. Decoding joins the pieces of the ids; any ids give
their bytes.

Defined results: null and empty texts have no ids; repeated rows are encoded one
by one; an empty table gives no rows; other columns are carried along, apart from
one named like the result, which it replaces. The time for one match of the
pattern grows with the square of its length.
"""

from __future__ import annotations

import base64
import io
import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shredline.session import ensure_checkpoint_dir

DICTIONARY = 350_000    # words whose ids are a literal
WORD_BYTES = 64         # longer words never enter the dictionary
_SCALE = 8              # steps of the count histogram for each doubling


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, which is also their id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ranges(chars: Iterable[str]) -> str:
    """The members of a character class for these characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


@lru_cache(maxsize=4)
def _beyond_java(spark: SparkSession) -> dict[str, str]:
    """Letters and numbers that tiktoken's Unicode tables know and this JVM's don't, as class members."""
    import tiktoken

    space = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    unknown = spark.range(1).select(F.regexp_replace(F.lit(space), r"[\p{L}\p{N}]+", "").alias("s")).first()["s"]
    ranks = {bytes([b]): b for b in range(256)}
    found = {}
    for kind in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=ranks, special_tokens={})
        found[kind] = _ranges(probe.decode(probe.encode_ordinary(unknown)))
    return found


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern for the JVM: Unicode white space, and the same letters and numbers as in tiktoken."""
    out, inside = [], False
    more = _beyond_java(spark)
    i = 0
    while i < len(pattern):
        part = next((k for k in more if pattern.startswith(k, i)), None)
        if part:
            members = part + (f"[\\P{{ASCII}}&&[{more[part]}]]" if more[part] else "")
            out.append(members if inside else f"[{members}]")
            i += len(part)
            continue
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return "(?U)" + "".join(out)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once and, if it is a literal, once in the plan."""
    return F.transform(F.array(value), body)[0]


class Lookup:
    """A literal map from strings to values with constant-time lookups."""

    def __init__(self, entries: dict, value_type: str):
        self.size = 1 << max(4, (len(entries) // 4).bit_length())
        keys = list(entries)
        slot = np.fromiter((xxhash.xxh64_intdigest(k.encode(), seed=42) & (self.size - 1) for k in keys), np.int64, len(keys))
        order = np.argsort(slot, kind="stable")
        edges = np.searchsorted(slot[order], np.arange(self.size + 1))
        text = io.StringIO()                               # slot by slot, so that no map is held here
        for i in range(self.size):
            own = {keys[k]: entries[keys[k]] for k in order[edges[i]:edges[i + 1]]}
            text.write(("," if i else "[") + json.dumps(own, separators=(",", ":")))
        text.write("]")
        self.table = F.from_json(F.lit(text.getvalue()), f"array<map<string,{value_type}>>")

    def bind(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """body(get), where get(key) is the key's value, null if it has none."""
        def get(table: Column) -> Callable[[Column], Column]:
            return lambda key: F.element_at(
                table[F.xxhash64(key).bitwiseAND(F.lit(self.size - 1)).cast("int")], key)
        return bind(self.table, lambda table: body(get(table)))


_FIRST = 0x100          # the character of token 0; those below stand for bytes
_NONE = chr(0x10FFFF)   # a pair that is no token, after all that are


def _char(token: int) -> str:
    """The character of a token, in the order of ranks; surrogates are left out."""
    c = token + _FIRST
    return chr(c if c < 0xD800 else c + 0x800)


class Bpe:
    """Ranks as literals, and the fold over them."""

    def __init__(self, ranks: dict[bytes, int]):
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must count from 0 without gaps and hold every byte")
        self.plain = len(ranks) + _FIRST <= 0xD800
        self.pairs = Lookup({_char(ranks[t[:i]]) + _char(ranks[t[i:]]): _char(r) for t, r in ranks.items()
                             for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}, "string")
        self.bytes = "".join(_char(ranks[bytes([b])]) for b in range(256))
        self.tokens = {}
        for t, r in ranks.items():
            try:
                self.tokens[t.decode()] = _char(r)
            except UnicodeDecodeError:      # part of a character: never a whole match
                pass
        self.pieces = F.from_json(F.lit(json.dumps([t.hex() for t in sorted(ranks, key=ranks.get)])), "array<string>")

    def chars(self, matches: Column, known: dict[str, str] | None = None) -> Column:
        """The tokens of an array of matches of the pattern, as characters; those in ``known`` are looked up."""
        whole = Lookup(self.tokens | (known or {}), "string")
        return self.pairs.bind(lambda rank: whole.bind(lambda find: F.array_join(F.transform(
            matches, lambda w: F.coalesce(find(w), self.fold(w, rank))), "")))

    def fold(self, word: Column, rank: Callable[[Column], Column]) -> Column:
        """What is left of a word's bytes when no two neighbours are a token."""
        def pair(p: Column) -> Column:
            return F.coalesce(rank(p), F.lit(_NONE))

        def merge(s: Column, r: Column, best: Column, at: Column) -> Column:
            joined = F.overlay(s, best, at, F.lit(2))
            return bind(joined, lambda s: F.struct(s.alias("s"), F.concat(
                F.substring(r, F.lit(1), at - 2),
                F.when(at > 1, pair(F.substring(s, at - 1, F.lit(2)))).otherwise(""),
                F.when(at < F.length(s), pair(F.substring(s, at, F.lit(2)))).otherwise(""),
                F.substring(r, at + 2, F.length(r))).alias("r")))

        def step(x: Column, _) -> Column:
            s, r = x["s"], x["r"]
            return F.when(r == "", x).otherwise(bind(F.array_min(F.split(r, "")), lambda best: F.when(
                best == _NONE, F.struct(s.alias("s"), F.lit("").alias("r"))).otherwise(
                    bind(F.instr(r, best), lambda at: merge(s, r, best, at)))))

        def start(s: Column) -> Column:
            pairs = F.regexp_extract_all(s, F.lit("(?s)(?=(..))"), F.lit(1))
            return F.struct(s.alias("s"), F.array_join(F.transform(pairs, pair), "").alias("r"))

        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return bind(F.translate(latin, "".join(map(chr, range(256))), self.bytes), lambda s: F.aggregate(
            F.sequence(F.lit(1), F.length(s)), start(s), step, lambda x: x["s"]))

    def ids(self, chars: Column) -> Column:
        """The tokens of a string of their characters."""
        def token(c: Column) -> Column:
            low = F.ascii(c) - _FIRST
            return low if self.plain else F.when(c < "\ue000", low).otherwise(F.ascii(c) - _FIRST - 0x800)
        return F.when(chars == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(chars, ""), token))

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids, joined."""
        return bind(self.pieces, lambda pieces: F.unhex(F.array_join(F.transform(ids, lambda i: pieces[i]), "")))


def words(spark: SparkSession, text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(spark, pattern)), F.lit(0))


def frequent_words(all_words: DataFrame, limit: int) -> DataFrame:
    """The most frequent of the words in column w, at most ``limit``, without a sort.

    A histogram of the counts on a logarithmic scale gives the least count to take.
    """
    ensure_checkpoint_dir(all_words.sparkSession)
    counts = (all_words.where(F.octet_length("w") <= WORD_BYTES).groupBy("w").agg(F.count("*").alias("n"))
              .where("n > 1").withColumn("step", F.floor(F.log2("n") * _SCALE).cast("int")).checkpoint())
    least, taken = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):     # at most 64 * _SCALE rows
        taken += r["count"]
        if taken > limit:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else F.col("step") >= least).select("w")


def encode(docs: DataFrame, model: Bpe | None = None, pattern: str | None = None, text: str = "text", out: str = "ids",
           dictionary: int = DICTIONARY) -> DataFrame:
    """docs with their token ids (array<int>) in column ``out``."""
    spark = docs.sparkSession
    model, pattern = model or Bpe(read_ranks(default_ranks())), pattern or default_pattern()
    split: Callable[[Column], Column] = lambda c: words(spark, c, pattern)
    known = {}
    if dictionary:
        often = frequent_words(docs.select(F.explode(split(F.col(text))).alias("w")), dictionary)
        rows = often.select("w", model.chars(F.array("w")).alias("chars")).toArrow()           # at most `dictionary`
        known = dict(zip(*(c.to_pylist() for c in rows.columns), strict=True))
    return docs.withColumn(out, model.chars(split(F.col(text)), known)).withColumn(out, model.ids(F.col(out)))
