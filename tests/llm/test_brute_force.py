"""Operators against brute force on small tables, with nulls, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from netloom.llm import _common, exact_dedup, language_id, line_dedup, lm_score, near_dedup, secret_scan

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingle_set(text, width):
    w = words(text)
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def components(rows, width, percent):
    """identifier -> (size of the set, least identifier reachable)."""
    sets = [(i, shingle_set(x, width)) for i, x in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both, every = len(sets[a][1] & sets[b][1]), len(sets[a][1] | sets[b][1])
            if every and sets[a][1] and sets[b][1] and 100 * both >= percent * every:
                x, y = sorted((root(a), root(b)), key=lambda k: sets[k][0])
                parent[y] = x
    return {i: (len(s), sets[root(k)][0]) for k, (i, s) in enumerate(sets)}


def family_rows(seed, families=25, size=6):
    """Texts at all distances around the threshold from their family's first text."""
    rnd, rows = random.Random(seed), []
    for f in range(families):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 120))]
        for _ in range(size):
            noise = rnd.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.15, 0.3])
            rows.append([w if rnd.random() >= noise else f"x{rnd.randint(0, 9999)}" for w in base])
    return [(1000 - k, " ".join(w).replace("w", "W", 3)) for k, w in enumerate(rows)] + [(1, None), (2, " \n"), (3, "one"), (4, "ONE")]


@pytest.mark.parametrize("percent", [50, 80])
@pytest.mark.parametrize("hot", [4096, 20])
def test_near_dedup(spark, monkeypatch, percent, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rows = family_rows(percent)
    table = spark.createDataFrame([(i, x, b"", 0) for i, x in rows], "doc_id long, text string, _set binary, key int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(table, width=2, percent=percent).collect()}
    want = components(rows, 2, percent)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_dedup_of_one_hot_key(spark, monkeypatch):
    """All texts share most words: keys are hot in every tree and are split into blocks."""
    monkeypatch.setattr(near_dedup, "HOT", 30)
    rnd = random.Random(9)
    rows = [(i, " ".join([f"c{k}" for k in range(60)] + [f"o{rnd.randint(0, 12)}_{k}" for k in range(25)])) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()}
    assert got == {i: c for i, (_, c) in components(rows, 1, 80).items()}


def test_near_dedup_refuses_what_it_cannot_find(spark):
    with pytest.raises(ValueError):
        near_dedup.near_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=20)
    assert near_dedup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lm_columns(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["The", "the", "cat", "dog", "Ünder", f"r{rnd.randint(0, 60)}"]) for _ in range(rnd.randint(0, 30)))) for i in range(120)]
    rows += [(200, None), (None, "the cat"), (5, "the cat"), (201, "long " * 30_000)]
    got = lm_score.score_texts(spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, key int")).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = {}
    for i, x in rows:
        if not held(i):
            for w in [*words(x), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, x in rows:
        t = [*words(x), None]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t)
        want.setdefault((repr(i), len(t)), (held(i), sum(w in counts for w in t), n, base))
    assert len(got) == len(rows)
    for r in got:
        h, known, total, base = want[repr(r["doc_id"]), r["n_tokens"]]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (h, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert lm_score.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language_id.identify(docs).collect()
    seen = [(truth[r["doc_id"]], r["lang_pred"]) for r in got if r["held_out"] and truth[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(got) == len(truth) and len(seen) > 20 and sum(a == b for a, b in seen) / len(seen) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text {i} " + "x" * 500, f"l{i % 3}") for i in range(300)] + [(None, "the same", "l1")] * 300
    texts, labels = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", rows=60, chars=100)
    assert 20 <= len(texts) <= 60 and max(map(len, texts)) <= 100 and set(labels) == {"l0", "l1", "l2"}
    assert texts.count("the same") <= 1
    assert language_id.sample(spark.createDataFrame([], "doc_id long, text string, lang string"), "doc_id", "text", "lang") == ([], [])


def test_more_languages_than_dimensions():
    texts, labels = [], []
    for k in range(20):
        texts += [f"{chr(97 + k) * 3} {chr(98 + k) * 2} " * 15] * 8
        labels += [f"l{k}"] * 8
    model = language_id.train(texts, labels, epochs=4)
    assert model.weights is not None
    assert sum(a == b for a, b in zip(model.predict(texts)[0], labels)) / len(labels) >= 0.9


def base_spans(text):
    """The contract's base patterns by plain search."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        out += [(m.start(), 0, m.end(), "assign")] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_secrets(spark):
    rnd = random.Random(8)
    parts = ["password", "Token", "api_key", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x", "\n", "é", "😀", "https://h/x", "user_id=abcdef", "{", "}"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(600)]
    rows += [(None, None), (700, ""), (5, rows[5][1]), (701, "password=hunter22 " * 20_000)]
    table = spark.createDataFrame([(i, x, "spans", "y") for i, x in rows], "doc_id long, text string, found string, _spans string")
    got = secret_scan.find_secrets(table).collect()
    assert len(got) == len(rows)
    have = sorted((repr(r["doc_id"]), [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] or [] if s["kind"] in ("assign", "access", "hex")]) for r in got)
    assert have == sorted((repr(i), base_spans(x)) for i, x in rows)
    clean = {r["doc_id"]: r for r in secret_scan.without_secrets(table).collect()}
    assert list(clean[700].asDict()) == table.columns and clean[700]["_spans"] == "y" and "hunter22" not in clean[701]["text"]
    assert clean[None]["text"] is None and secret_scan.find_secrets(table.limit(0)).count() == 0


def test_digest_filters_hold_their_keys(spark):
    rows = spark.range(3000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("k"))
    keys = rows.where("id % 7 = 0").select("k")
    where = _common.work_dir(spark)
    for bits in (None, 1 << 15, 1 << 9):
        f = exact_dedup.DigestFilter(keys, "k", f"{where}/{bits}", bits)
        got = {r["id"] for r in f.maybe_in(rows, "k").collect()}
        assert got >= set(range(0, 3000, 7)) and (len(got) < 600 or not f.useful)


def test_identifiers_that_are_no_integers_are_refused(spark):
    texts = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for run in (exact_dedup.exact_dedup, line_dedup.line_dedup, near_dedup.near_dedup):
        with pytest.raises(TypeError):
            run(texts)


def test_line_dedup_keeps_other_columns(spark):
    line = "a line that is long enough to count"
    rows = [(i, f"{line}\n{i}", "a", "b", 9) for i in range(4)] + [(7, None, "a", "b", 9), (3, f"{line}\n3", "a", "b", 9)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, _id string, _drop string, n_lines int"))
    out = sorted((r["doc_id"], r["text"], r["_id"], r["_drop"], r["n_lines"], r["n_dropped"]) for r in got.collect())
    kept = f"{line}\n3"
    assert out == [(0, "0", "a", "b", 2, 1), (1, "1", "a", "b", 2, 1), (2, "2", "a", "b", 2, 1), (3, kept, "a", "b", 2, 0), (3, kept, "a", "b", 2, 0), (7, "", "a", "b", 1, 0)]


def test_exact_dedup_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 60), rnd.choice(["A", "a", "b", "É", "é", None, "", "B c"])) for _ in range(200)]
    got = exact_dedup.exact_dedup(spark.createDataFrame([(i, x, "z") for i, x in rows], "doc_id long, text string, _digest string")).collect()
    groups = {}
    for i, x in rows:
        groups.setdefault(lower(x), []).append(i)
    want = sorted((i, max(groups[lower(x)]), len(groups[lower(x)]), i == max(groups[lower(x)]), hashlib.sha256(lower(x).encode()).hexdigest()) for i, x in rows)
    assert sorted(map(tuple, got)) == want
