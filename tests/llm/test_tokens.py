"""Token identifiers against the tokenizers library, packing against its contract."""

import random
import zlib
from array import array

import pyarrow as pa
import pytest

from netloom.llm import bpe, packing

SPECIAL = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "<|endoftext|", "<|", "|>"]
PARTS = ["a", "A", "'s", "'LL", "'", " ", "  ", "\n", "\t", "12", "!", "é", "é", "漢", "😀", "\x1c", "\x85", " ", "​", " ", "the", ". ", ",\n", "=", "²", "_. ", "\r\n", "\0"]
TEXTS = 2_000  # 20,000 when the tokenizing code changes


def texts(seed, longest, parts=PARTS + SPECIAL):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, longest))) for _ in range(TEXTS)]


@pytest.fixture(scope="module")
def tree():
    return bpe.TreeBpe("byte_bpe_50k.json")


def test_tree_bpe_equals_the_library(tree):
    rnd = random.Random(3)
    for x in texts(1, 80):
        tree.leaf_chars = rnd.randint(1, 30)
        ids = tree.encode([x])
        assert ids == tree.encode_whole([x]), (x, tree.leaf_chars)
        assert tree.decode(ids[0]) == x


def test_special_tokens_around_the_cuts_of_shipped_leaves(tree):
    tree.leaf_chars = 4096
    for n, odd in enumerate(["\x85", " ", "​", "\t", "\x1c", "  ", "\n\n", ""]):
        for at in range(-30, 31, 3):
            x = "word " * 819 + "x" * (10 + at) + f" {odd}<|endoftext|>{odd} tail" + " word" * 830
            assert tree.encode([x]) == tree.encode_whole([x]), (n, at)


def test_word_tokens_equal_the_library():
    words = packing.WordTokens("word_bpe_49k.json")
    every = texts(4, 60)
    for i in range(0, len(every), 50):
        assert words.encode(every[i : i + 50]) == words.encode_whole(every[i : i + 50])


def test_words_end_where_the_library_ends_them():
    """Letters that become a letter and a mark run on into the full stop."""
    words = packing.WordTokens("word_bpe_49k.json")
    odd = ["\u0130. ", "\u0958. ", "\ufb1d, ", "H\u0331.\n", "\u017f's", "'5", "5's", "3.14,", "<\u0338", "a.\u0338", "\u0416.", "\u03a3. ", "\u00d7.", "\x01", "a\x01.", "\t", "$$$ ", "x@y.com", "\ud55c.", ".\u0301 "]
    every = [*odd, *texts(5, 30, PARTS + SPECIAL[-3:] + odd)]
    for i in range(0, len(every), 50):
        assert words.encode(every[i : i + 50]) == words.encode_whole(every[i : i + 50])


def test_new_words_go_to_the_library_together():
    words = packing.WordTokens("word_bpe_49k.json")
    rnd = random.Random(7)
    x = " ".join("".join(rnd.choice("abc\u00e9!7") for _ in range(9)) for _ in range(5_000))
    want, given = words.encode_whole([x]), []
    library = words.encode_whole
    words.encode_whole = lambda texts: given.extend(texts) or library(texts)
    assert words.encode([x]) == want
    assert len(given) <= 4


def test_slices_of_arrow_columns_and_small_gathers(monkeypatch):
    words = packing.WordTokens("word_bpe_49k.json")
    monkeypatch.setattr(packing, "GATHERED", 3)
    rows = ["first", None, "", "one two  three.\n", "<|ENDOFTEXT|> x", "\u00c9t\u00e9, 12 a", "last"]
    for kind in (pa.string(), pa.large_string()):
        part = pa.array(rows, kind).slice(1, 5)
        assert words.encode_array(part) == words.encode_whole([x or "" for x in rows[1:6]])


def test_few_remembered_words():
    words = packing.WordTokens("word_bpe_49k.json")
    words.remembered = 50
    for x in texts(8, 40)[:200]:
        assert words.encode([x]) == words.encode_whole([x])
        assert len(words.known) <= 51 and len(words.earlier) <= 150


ROWS = [(1, None), (2, ""), (3, "Hello <|endoftext|> World"), (4, "same"), (4, "same"), (None, "no identifier"), (5, "very long text. " * 9000 + "<|endoftext|>" + "ü " * 40_000), (5, "very long text. " * 9000 + "<|endoftext|>" + "ü " * 40_000)]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, x, "extra", 7) for i, x in rows], "doc_id long, text string, ids string, `key` int")


def library(name, x):
    found = bpe.WordCache(name)
    return array("I", found.library.encode(x or "", add_special_tokens=False).ids).tobytes()


def test_bpe_of_odd_rows_and_of_chunks(spark):
    got = bpe.bpe_encode(table(spark), long_chars=50_000).collect()
    want = sorted((repr(i), library("byte_bpe_50k.json", x), x or "") for i, x in ROWS)
    assert sorted((repr(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.bpe_encode(table(spark).limit(0)).count() == 0


def check_packing(pieces, rows, capacity=4096):
    """Every id of every row in one piece, sequences gapless, full or a power of two long."""
    want = sorted((repr(i), library("word_bpe_49k.json", x) + (2).to_bytes(4, "little")) for i, x in rows)
    docs, sequences = {}, {}
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        docs.setdefault((repr(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    got = []
    for (i, n), parts in docs.items():
        copies = sum(len(x) for _, x in parts) // (4 * n)
        by_start = {}
        for start, x in parts:
            by_start.setdefault(start, []).append(x)
        if copies == 1:
            at = 0
            for start in sorted(by_start):
                assert start == at and len(by_start[start]) == 1
                at += len(by_start[start][0]) // 4
            got.append((i, b"".join(by_start[s][0] for s in sorted(by_start))))
        else:  # copies may be cut apart at different places
            whole = next(x for k, x in want if k == i and len(x) == 4 * n)
            held = [0] * n
            for start, x in parts:
                assert whole[4 * start : 4 * start + len(x)] == x
                for k in range(start, start + len(x) // 4):
                    held[k] += 1
            assert set(held) == {copies}
            got += [(i, whole)] * copies
    assert sorted(got) == want


def test_packing_of_odd_rows(spark):
    check_packing(packing.pack_documents(table(spark).coalesce(1)).collect(), ROWS)
    check_packing(packing.pack_documents(table(spark).repartition(3)).collect(), ROWS)
    assert packing.pack_documents(table(spark).limit(0)).count() == 0


def test_packing_with_ties_and_small_buffers(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["cat", "dog", "fish"]) for _ in range(rnd.choice([3, 3, 3, 40, 200])))) for i in range(300)]
    pieces = packing.pack_documents(table(spark, rows).repartition(2), capacity=64, buffer_tokens=512).collect()
    check_packing(pieces, rows, capacity=64)
    assert len({r["sequence_id"] for r in pieces}) <= sum(r["length"] for r in pieces) // 64 + 2 * 7


def test_cost_balance():
    sequences, left = packing.assign([50, 40, 30, 30, 20, 10], [64, 64, 64])
    assert not left and [sum(n for _, _, n in s) for s in sequences] == [60, 60, 60]


def test_digest_columns(spark):
    r = packing.with_digest(packing.pack_documents(table(spark, [(3, "hello")]))).first()
    assert r["ids_crc32"] == zlib.crc32(library("word_bpe_49k.json", "hello") + (2).to_bytes(4, "little")) or r["length"] < r["doc_tokens"]


def test_decode_of_bytes_outside_utf8(tree):
    half = tree.library.encode("漢").ids[:1]
    assert tree.decode(array("I", half).tobytes()) == tree.library.decode(half, skip_special_tokens=False)
