import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from frames import frame  # noqa: F401
from shredline.llm import bpe as B
from shredline.llm.queries import op11_byte_bpe

TEXTS = [None, "", " ", "a", "Hello world. It's a test!'ll 'LL", " lead", "a" * 500, "é x 　y  \n\n z", "\x00\x01\r\n\t\v\x85  x",
         "日本語 text 😀😀 ፩ ½ Ⅷ ՘\U0001e4f0 \U0002ebf0\U00010d40", " " * 300 + "x", "<|endoftext|> as text", "a b " * 2000, "wordword " * 400]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=B.default_pattern(), mergeable_ranks=B.read_ranks(B.default_ranks()), special_tokens={})


@pytest.fixture(scope="module")
def model():
    return B.Bpe(B.read_ranks(B.default_ranks()))


@pytest.mark.parametrize("dictionary", [0, 30])
def test_ids_equal_tiktoken_and_decode_to_the_text(frame, library, model, dictionary):  # noqa: F811
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab. \n\té'1 ,l日՘\U000116d0²") for _ in range(200)) for _ in range(20)]
    texts += ["".join(chr(r.choice([r.randrange(32, 592), r.randrange(32, 0xD800), r.randrange(0xE000, 0x110000)]))
                      for _ in range(200)) for _ in range(20)]
    docs = frame([(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "null id")])
    rows = B.encode(docs, model, dictionary=dictionary).withColumn("bytes", model.decode(F.col("ids"))).collect()
    assert len(rows) == len(texts) + 2 and "fp" in rows[0]
    for row in rows:
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.bytes) == (row.text or "").encode()


def test_small_vocabulary_where_a_late_pair_has_a_lower_rank(frame):  # noqa: F811
    """Ranks that no training gave: merges must follow the ranks, leftmost first, not the length or the order made."""
    tokens = [bytes([b]) for b in range(256)] + [b"bab", b"ab", b"ba", b"abab", b"aab", b"abb", b"bb", b"aabb"]
    ranks = {t: i for i, t in enumerate(tokens)}
    own = tiktoken.Encoding("own", pat_str=B.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 14))) for _ in range(300)]
    for row in B.encode(frame(list(enumerate(texts))), B.Bpe(ranks), dictionary=0).collect():
        assert row.ids == own.encode_ordinary(row.text), row.text


def test_ids_of_no_text_and_an_empty_table(spark, frame, model):  # noqa: F811
    one = spark.range(1).select(model.decode(F.array(F.lit(200), F.lit(201))).alias("b")).first()
    tokens = {v: k for k, v in B.read_ranks(B.default_ranks()).items()}
    assert bytes(one.b) == tokens[200] + tokens[201]
    assert B.encode(frame([]).drop("text").withColumn("text", F.lit(None).cast("string")), model).count() == 0


def test_ranks_must_be_whole():
    for bad in ({b"a": 0, b"b": 2}, {b"a": 0, b"b": 1}):
        with pytest.raises(ValueError):
            B.Bpe(bad)


def test_more_tokens_than_plain_characters(frame):  # noqa: F811
    """Ids beyond the surrogates keep their order and come back."""
    tokens = [bytes([b]) for b in range(256)] + [b"%d" % i for i in range(10_000, 70_000)] + [b"ab", b"ba", b"aba"]
    tokens += [bytes([a, b]) for a in b"0123456789" for b in b"0123456789"] + [b"%d" % i for i in range(100, 1000)]
    ranks = {t: i for i, t in enumerate(tokens)}
    own = tiktoken.Encoding("own", pat_str=B.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    model = B.Bpe(ranks)
    texts = ["ababa 69999 123456789012 5 x69998", "abab" * 5, "6999969999 12"]
    for row in B.encode(frame(list(enumerate(texts))), model, dictionary=0).withColumn("b", model.decode(F.col("ids"))).collect():
        assert row.ids == own.encode_ordinary(row.text) and bytes(row.b) == row.text.encode()
    assert max(own.encode_ordinary("69999")) > 0xD800


def test_dictionary_is_bounded_and_holds_the_most_frequent(spark):
    words = spark.createDataFrame([(f"w{i:02}",) for i in range(40) for _ in range(1 + i)], "w string")
    got = {r.w for r in B.frequent_words(words, 10).collect()}
    assert 0 < len(got) <= 10 and "w39" in got and min(int(w[1:]) for w in got) == 40 - len(got)
    assert not B.frequent_words(words.limit(0), 10).collect()


def test_query_equals_tiktoken(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_byte_bpe(spark, sf).collect()}
    assert got == want
