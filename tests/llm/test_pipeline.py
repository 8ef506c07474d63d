"""The pipeline and the registered queries over the small tables."""
import __spark_entry__ as E
import corpus_pipeline as C
import pytest
from tokenizers import Tokenizer

from shredline.llm import decontamination, packing, pii, quality, simhash
from test_packing import check
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    """Base rules, fingerprints, contamination and packing by brute force; the fitted models by direct calls."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.fit(docs, labels)
    kept = [(d, t) for d, t in rows if quality.measure([t.encode() if t else None], model, 0.5)[0][6]]
    groups = {d: low for d, _, low in brute_components([(d, brute_fp(t)) for d, t in kept])}
    kept = [(d, t) for d, t in kept if groups[d] == d]
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = decontamination.brute_force([(d, t.encode() if t else t) for d, t in kept], items)
    kept = [(d, t) for d, t in kept if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])]
    weights = pii.fit(spark.createDataFrame(kept, "doc_id long, text string"))
    kept = [(d, pii.mask_text(t, weights)) for d, t in kept]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    check(kept, C.run(spark, SF).collect(), tok)


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_stages_take_odd_rows(spark, stage):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", None, None, None, "x"), (None, "no id here", "en", "s", 1, "x"),
            (3, "same", "en", "s", 4, "x"), (3, "same", "en", "s", 4, "x"), (4, "w " * 9000, "en", "s", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    assert out.columns == list(C.COLUMNS) or stage is C.pack
    out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_clean_documents_stay(spark):
    """Of labelled good documents of 50 words the quality stage keeps nearly all; a lone one passes every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    good = docs.join(labels, "doc_id").where("size(split(text, ' ')) >= 60")
    kept = C.quality_rules(spark, docs, SF).join(labels, "doc_id", "left_semi").join(good.select("doc_id"), "doc_id")
    assert kept.count() >= 0.97 * good.count()


def test_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert "pipeline" in E.queries() and set(n for n in E.oracle_sql() if n in names) == {"op2_license_scan", "op4_decontamination"}


def test_simhash_keeps_the_smallest_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = simhash.near_duplicates(docs).collect()
    want = {d: low for d, _, low in brute_components([(r.doc_id, brute_fp(r.text)) for r in docs.collect()])}
    assert {f.doc_id: f.component_id for f in found} == want
