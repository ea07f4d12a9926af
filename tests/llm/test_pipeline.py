"""The pipeline against a brute-force version of its stages, and each stage with odd rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from netloom.llm import secret_scan  # noqa: E402
from test_brute_force import components, lower  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag string, _maybe int"
EN = "the cat sat on the mat and then it ran away from the dog in the garden "
DE = "der hund und die katze sind nicht im haus sondern im garten hinter dem baum "


def rows():
    out = []
    for i in range(60):
        lang, text = ("en", EN) if i % 2 else ("de", DE)
        out.append((i, f"{text}{' '.join(f'w{(i * 37 + k * k) % 101}' for k in range(60))} number {i}", lang))
    out += [(100, out[3][1].upper(), "en"), (101, out[3][1], None), (101, out[3][1], None)]  # exact copies and a repeated row
    out += [(102, out[4][1] + " more", "de"), (103, None, "en"), (104, "", "en"), (105, "12 34", None), (106, EN + "password=hunter22secret", "en")]
    return [(i, x, lang, "s", len(x or ""), "tag", i % 3) for i, x, lang in out]


def test_stages_against_brute_force(spark):
    have = rows()
    docs = spark.createDataFrame(have, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    kept = stages["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    named = key(kept)
    gone = {r[0] for r in have} - {i for i, _ in named}
    assert {103, 104, 105} <= gone and len(gone) <= 5
    exact = stages["exact_dedup"](spark, kept, "")
    largest = {}
    for i, x in named:
        largest[lower(x)] = max(largest.get(lower(x), (-1, "")), (i, x))
    assert key(exact) == sorted(largest.values()) and exact.columns == docs.columns
    near = stages["near_dedup"](spark, exact, "")
    parts = components(key(exact), 5, 80)
    assert key(near) == sorted((i, x) for i, x in key(exact) if parts[i][1] == i)
    clean = stages["secret_scan"](spark, near, "")
    assert key(clean) == sorted((i, secret_scan.redacted(x, secret_scan.spans(x))) for i, x in key(near))
    assert all(r["n_chars"] == len(r["text"]) and r["_tag"] == "tag" for r in clean.collect())
    pieces = stages["packing"](spark, clean, "").toPandas()
    whole = pieces.groupby("doc_id").agg(length=("length", "sum"), tokens=("doc_tokens", "first"))
    assert (whole.length == whole.tokens).all() and set(whole.index) == {i for i, _ in key(clean)}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, "a", 1), (1, "", "en", "s", 0, "a", 1), (2, "x " * 60_000, "en", "s", 0, "a", 1), (2, "x " * 60_000, "en", "s", 0, "b", 1)]
    out = stage(spark, spark.createDataFrame(odd, SCHEMA), "")
    n = out.count()
    assert n > 0 if name != "language_id" else n >= 0
    empty = stage(spark, spark.createDataFrame([], SCHEMA), "")
    assert empty.count() == 0
    if name != "packing":
        assert out.columns == empty.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    if name == "exact_dedup":
        assert sorted((r["doc_id"], r["_tag"]) for r in out.collect()) == [(1, "a"), (2, "a")]
