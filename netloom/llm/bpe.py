"""BPE encoding by tree concatenation, and decoding.

Special tokens are taken out first, as the library does; what lies between them is encoded on its own. A text
is halved down to leaves; all leaves of a batch are encoded alike, independent of each other. Texts longer
than LONG_CHARS are cut to chunks that tasks encode in parallel. The halves are then joined bottom-up: a
window of tokens around the join is encoded anew and grows until it holds, on either side, a token that also
stands at the same bytes in that side's own encoding. From there on both encodings agree: adjacent tokens of a
valid encoding are valid pairs, a sequence of valid pairs is the encoding of its text, and the tokenizer's
splitting looks no further than one character ahead. The window's first token (and its last) may start (or
end) inside a word and doesn't count, unless the window reaches that end of the text. If no such tokens
appear, the window grows to both whole sides.

Leaves are encoded by word: a blank or line feed after another character always starts a new word of the
byte-level splitting rule, so each piece of white space with the word after it is encoded on its own by the
tokenizers library and remembered. Leaves with other white space go to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from . import _common

#: Words of a generation; a Python worker remembers two of them. Characters of the longest such word.
REMEMBERED, LONGEST = 150_000, 64
#: A full stop or comma at a word's end: between a letter or digit and punctuation a new part always begins.
END_MARK = re.compile(r"([.,])(?=[ \n])(?<=[^\W_][.,])")
#: White space and the word after it, up to a mark.
PIECE = re.compile(r"[ \n]*[^ \n\0]+|[ \n]+")
#: White space but blank and line feed, by any Unicode version.
UNUSUAL = re.compile("[^\\S \n]|[\0\u180e\u200b\ufeff]")
#: Characters of a chunk of a text that is encoded by several tasks.
LONG_CHARS = 1 << 16

class WordCache:
    """Encodes lists of words with the tokenizers library; frequent words only once."""

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{name}: added tokens that take in their surroundings are not supported")
        #: Special tokens, longest first, and their identifiers.
        self.special = {t.content: i for i, t in sorted(added.items(), key=lambda x: -len(x[1].content))}
        self.remembered = REMEMBERED
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.earlier: dict[str, bytes] = {}

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """By the library, without the offsets that nobody asks for."""
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of words, as unsigned 32-bit integers."""
        new = set()
        for words in lists:
            new.update(words)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, words)) for words in lists]
        self._age()
        return out

    def encode_distinct(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        self._learn(set(words))
        out = list(map(self.known.__getitem__, words))
        self._age()
        return out

    def encode_new(self, words: list[str]) -> list[bytes]:
        """The ids of words that aren't remembered."""
        return self.encode_whole(words)

    def _learn(self, words: set[str]) -> None:
        known, earlier, miss = self.known, self.earlier, []
        for w in words.difference(known):  # looks up the few new words, not all known ones
            if (ids := earlier.get(w)) is None:
                miss.append(w)
            else:
                known[w] = ids
        for i in range(0, len(miss), 20_000):
            part = miss[i : i + 20_000]
            known.update(zip(part, self.encode_new(part)))

    def _age(self) -> None:
        if len(known := self.known) > self.remembered:  # words of the last generation are kept until this one is full
            self.earlier = {w: x for w, x in known.items() if len(w) <= LONGEST}
            self.known = {"": b""}


def loaded(kind: type, name: str):
    """One instance for each Python worker."""
    kept = _common.worker_memory(kind.__name__)
    if name not in kept:
        kept[name] = kind(name)
    return kept[name]


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeBpe(WordCache):
    """Byte-level BPE by tree concatenation."""

    def __init__(self, name: str, leaf_chars: int = 4096):
        super().__init__(name)
        self.leaf_chars = leaf_chars
        letters = _byte_alphabet()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.cut = re.compile("(" + ("|".join(map(re.escape, self.special)) or "(?!)") + ")")
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        self.size_of = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.windows = 0

    def encode_leaves(self, leaves: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(leaves)
        usual = [i for i, x in enumerate(leaves) if not UNUSUAL.search(x)]
        for i, ids in zip(usual, self.encode_words([PIECE.findall(END_MARK.sub("\0\\1", leaves[i])) for i in usual])):
            out[i] = ids
        odd = sorted(set(range(len(leaves))) - set(usual))
        for i, ids in zip(odd, self.encode_whole([leaves[i] for i in odd])):
            out[i] = ids
        return out

    def join(self, a: tuple[np.ndarray, bytes], b: tuple[np.ndarray, bytes]) -> tuple[np.ndarray, bytes]:
        (left, left_text), (right, right_text) = a, b
        n = 8
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            at = len(left_text) - int(self.size_of[left[i:]].sum())
            while i and left_text[at] & 0xC0 == 0x80:  # inside a character
                i -= 1
                at -= int(self.size_of[left[i]])
            to = int(self.size_of[right[:j]].sum())
            while j < len(right) and right_text[to] & 0xC0 == 0x80:
                to += int(self.size_of[right[j]])
                j += 1
            ids = np.frombuffer(self.encode_leaves([(left_text[at:] + right_text[:to]).decode()])[0], dtype=np.uint32)
            self.windows += 1
            # Byte spans (start, end) of the tokens, counted from the start of the window.
            ends = np.cumsum(self.size_of[ids])
            spans = {(int(e - s), int(e)): k for k, (e, s) in enumerate(zip(ends, self.size_of[ids]))}
            first, start = (0, 0) if i == 0 else (None, None)
            if i:
                e = np.cumsum(self.size_of[left[i:]])
                for k, (x, s) in enumerate(zip(e.tolist(), self.size_of[left[i:]].tolist())):
                    if (m := spans.get((x - s, x))) is not None and m > 0:
                        first, start = i + k, m
                        break
            last, stop = (len(right), len(ids)) if j == len(right) else (None, None)
            if j < len(right):
                e = np.cumsum(self.size_of[right[:j]]) + (len(left_text) - at)
                for k in range(j - 1, -1, -1):
                    x = int(e[k])
                    m = spans.get((x - int(self.size_of[right[k]]), x))
                    if m is not None and m < len(ids) - 1:
                        last, stop = k, m
                        break
            if first is not None and last is not None and start <= stop:
                return np.concatenate([left[:first], ids[start:stop], right[last:]]), left_text + right_text
            n *= 2

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; special tokens are found in it first."""
        cut = [self.cut.split(x) for x in texts]  # plain parts at even places
        ids = iter(self.encode_plain([part for parts in cut for part in parts[::2]]))
        out = []
        for parts in cut:
            out.append(b"".join(next(ids) if k % 2 == 0 else self.special_id(part) for k, part in enumerate(parts)))
        return out

    def special_id(self, token: str) -> bytes:
        return self.special[token].to_bytes(4, "little")

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens, by tree concatenation."""
        leaves: list[str] = []
        spans = []
        for text in texts:
            parts = 1
            while len(text) > parts * self.leaf_chars:
                parts *= 2
            cuts = [len(text) * k // parts for k in range(parts + 1)]
            spans.append((len(leaves), parts))
            leaves += [text[x:y] for x, y in zip(cuts, cuts[1:])]
        ids = self.encode_leaves(leaves)
        return [self.joined([(np.frombuffer(ids[k], dtype=np.uint32), leaves[k].encode()) for k in range(at, at + parts)])[0].tobytes() for at, parts in spans]

    def joined(self, nodes: list[tuple[np.ndarray, bytes]]) -> tuple[np.ndarray, bytes]:
        """Joins neighbouring nodes, level by level, to one."""
        while len(nodes) > 1:
            last = nodes[len(nodes) & ~1 :]
            nodes = [self.join(x, y) for x, y in zip(nodes[::2], nodes[1::2])] + last
        return nodes[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype=np.uint32).tolist())).decode("utf-8", "replace")


def bpe_encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", decode: bool = True, long_chars: int = LONG_CHARS
) -> DataFrame:
    """(identifier, ids, decoded): ids as little-endian unsigned 32-bit integers of the whole text.

    `tokenizer` is a name for public_tokenizers.path or a path that every executor can open. Texts of long_chars
    characters at most aren't shuffled: each partition streams through one worker. Longer ones are cut to chunks
    that are dealt to tasks; the task that joins a text holds it whole. Null text is empty text (no ids); null
    or repeated identifiers are kept as they are, a row for each row; an empty table gives no rows. Other
    columns are neither read nor returned.
    """
    _common.shipped(docs.sparkSession)
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("ids", BinaryType()), StructField("decoded", StringType())])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    is_long = F.char_length("text") > long_chars

    def short(batches):
        bpe = loaded(TreeBpe, tokenizer)
        for batch in batches:
            for i, texts in _common.text_parts(batch, 1):
                ids = bpe.encode(texts)
                back = pa.array(map(bpe.decode, ids), pa.string()) if decode else pa.nulls(len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(ids)), pa.array(ids, pa.binary()), back], schema.names)

    whole = rows.where(~is_long).mapInArrow(short, schema)
    return whole.unionByName(_encoded_in_chunks(rows.where(is_long), schema, tokenizer, decode, long_chars)).withColumnRenamed("id", id_col)


def _encoded_in_chunks(rows: DataFrame, schema: StructType, tokenizer: str, decode: bool, long_chars: int) -> DataFrame:
    """Long texts: equal rows are encoded once, chunk by chunk in parallel, and joined in order."""
    key = _common.digest128(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text"))
    once = rows.withColumn("key", key).groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    named = [StructField("key", BinaryType()), StructField("at", LongType()), schema["id"], StructField("copies", LongType())]
    # A chunk begins a part between special tokens or continues it, or else is a special token.
    chunk = StructType([*named, StructField("first", BooleanType()), StructField("special", BooleanType()), StructField("text", StringType())])

    def cut(batches):
        bpe = loaded(TreeBpe, tokenizer)
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1).to_pylist()[0]
                found = []
                for n, part in enumerate(bpe.cut.split(own["text"])):
                    found += [(i == 0, n % 2 == 1, part[i : i + long_chars]) for i in range(0, len(part), long_chars)]
                for i in range(0, len(found), 64):
                    part = found[i : i + 64]
                    yield pa.RecordBatch.from_pylist([{"key": own["key"], "at": i + n, "id": own["id"], "copies": own["copies"], "first": f, "special": s, "text": x} for n, (f, s, x) in enumerate(part)], batch_schema(batch, chunk))

    def encode(batches):
        bpe = loaded(TreeBpe, tokenizer)
        for batch in batches:
            special = batch.column(5).to_pylist()
            for i, texts in _common.text_parts(batch, 6):
                ids = [bpe.special_id(x) if s else bpe.encode_plain([x])[0] for s, x in zip(special[i:], texts)]
                rows = batch.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.binary())], [*rows.schema.names, "ids"])

    def join(batches):
        bpe = loaded(TreeBpe, tokenizer)
        now, done, open_ = None, [], []

        def closed():
            if open_:
                done.append(bpe.joined(list(open_))[0].tobytes())
                open_.clear()

        def row(own, kind):
            closed()
            ids = b"".join(done)
            done.clear()
            back = bpe.decode(ids) if decode else None
            for _ in range(own["copies"]):
                yield pa.RecordBatch.from_arrays([pa.array([own["id"]], kind), pa.array([ids], pa.binary()), pa.array([back], pa.string())], schema.names)

        for batch in batches:
            kind = batch.schema.field("id").type
            for k in range(batch.num_rows):
                own = batch.slice(k, 1).to_pylist()[0]
                if now is not None and own["key"] != now["key"]:
                    yield from row(now, kind)
                if own["first"]:
                    closed()
                if own["special"]:
                    done.append(own["ids"])
                else:
                    open_.append((np.frombuffer(own["ids"], dtype=np.uint32), own["text"].encode()))
                now = {n: own[n] for n in ("key", "id", "copies")}
        if now is not None:
            yield from row(now, kind)

    chunks = once.select("key", "id", "text", "copies").mapInArrow(cut, chunk).repartition("key", "at")
    ids = chunks.mapInArrow(encode, StructType([*chunk.fields, StructField("ids", BinaryType())]))
    return ids.repartition("key").sortWithinPartitions("key", "at").mapInArrow(join, schema)


def batch_schema(batch: pa.RecordBatch, wanted: StructType) -> pa.Schema:
    """`wanted` in Arrow's types; the identifier keeps the type that it has in the batch."""
    kinds = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(f.name, batch.schema.field("id").type if f.name == "id" else kinds[f.dataType.typeName()]) for f in wanted])


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    out = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
