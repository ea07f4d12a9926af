"""Cost-balanced packing of token sequences.

A document is cut into full sequences and a rest. The rests of a bounded buffer are packed together: each
sequence has an estimated attention cost, LINEAR * n + QUADRATIC * n^2 summed over its pieces; documents in
descending order of cost go to the sequence of the lowest cost that has room for them. What fits nowhere is
cut and fills the room left, cheapest sequence first; what is left then waits for the next buffer. At a
partition's end the capacities are full sequences and the binary digits of the rest, so that every sequence
is full or as long as a power of two and nothing is padded.

Packing needs no shuffle: sequences are formed inside a partition and named after it. Memory is bounded by
the buffer and the longest document.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import _common, bpe

CAPACITY = 4096
#: Cost of n tokens that attend to each other: projections grow with n, attention with its square.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
END_ID = 2
#: A part of its own for the library, of one token; words that hold it are encoded alone.
SEPARATOR = "\x01"
#: Words whose ids are put together at a time.
GATHERED = 100_000
#: Words of a generation and bytes of text at a time where a worker lets go of its words.
FEW_WORDS, FEW_BYTES = 60_000, 1_000_000
#: Kinds of bytes; other ones are 0.
BLANK, DIGIT, LETTER, MARK = 1, 2, 3, 4


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and which pairs of bytes are a letter that stays one in normal form and lower case."""
    kinds = np.zeros(256, dtype=np.uint8)
    for b in range(33, 127):
        kinds[b] = DIGIT if chr(b).isdigit() else LETTER if chr(b).isalpha() else MARK
    kinds[[10, 32]] = BLANK
    pairs = np.zeros((256, 256), dtype=bool)
    pairs[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1], 0x80:0xC0] = True
    pairs[[0xC3, 0xC3, 0xC4], [0x97, 0xB7, 0xB0]] = False  # multiplication and division signs, dotted capital I
    return kinds, pairs


KIND, LETTER_PAIR = _kinds()


def cut_words(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of all texts, with the blank before them; the first word of each text and the end of the last.

    A word begins at a blank or line feed, before and after a digit (to the library a digit is a part of its own),
    and where an ASCII mark follows a letter or digit. The library begins a new part there, whatever stands around,
    and its normal form and lower case join nothing over these places.
    """
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KIND[data]
    first = (kind == BLANK) | (kind == DIGIT)
    first[1:] |= (kind[:-1] == DIGIT) & (data[1:] < 128)
    first[1:] |= (kind[:-1] == LETTER) & (kind[1:] == MARK)
    marks = np.flatnonzero((kind[2:] == MARK) & (data[1:-1] >= 128)) + 2
    first[marks[LETTER_PAIR[data[marks - 2], data[marks - 1]]]] = True
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    data = np.where(data == 10, np.uint8(32), data)
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)), bounds


class WordTokens(bpe.WordCache):
    """A lower-case vocabulary that drops white space and marks the last token of each part with `</w>`.

    Texts are cut to words as bytes, all texts of a run of rows at once. Each distinct word is looked up once;
    new ones are encoded by the library together, as one text. The library looks for special tokens before it
    lower-cases, so texts that hold one in any case go to it whole."""

    def __init__(self, name: str):
        super().__init__(name)
        self.odd = re.compile("|".join(map(re.escape, self.special)) or "(?!)", re.IGNORECASE)
        #: What all special tokens begin with, in any case.
        self.opening = re.match(r"[\x00-@\[-`{-\x7f]*", os.path.commonprefix(list(self.special)))[0]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        (self.separator,) = self.library.encode(SEPARATOR, add_special_tokens=False).ids

    def encode_new(self, words: list[str]) -> list[bytes]:
        """Letters only: a word is one part, which ends with an end token. Others stand between separators."""
        out = [b""] * len(words)
        letters = [k for k, w in enumerate(words) if w.isalpha()]
        others = [k for k, w in enumerate(words) if not w.isalpha() and SEPARATOR not in w]
        alone = [k for k, w in enumerate(words) if SEPARATOR in w]
        ids = self._joined([words[k] for k in letters], " ")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) == len(letters):
            self._cut(out, letters, ids, np.r_[0, ends[:-1]], ends)
        else:  # a letter that becomes something else in lower case, or isn't one to the library
            others += letters
        ids = self._joined([words[k] for k in others], f" {SEPARATOR} ")
        at = np.flatnonzero(ids == self.separator)
        if len(at) == max(0, len(others) - 1):
            self._cut(out, others, ids, np.r_[0, at + 1], np.r_[at, len(ids)])
        else:
            alone += others
        for k, ids in zip(alone, self.encode_whole([words[k] for k in alone])):
            out[k] = ids
        return out

    def _joined(self, words: list[str], between: str) -> np.ndarray:
        return np.frombuffer(self.encode_whole([between.join(words)])[0], dtype=np.uint32)

    @staticmethod
    def _cut(out: list[bytes], places: list[int], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = ids.tobytes()
        for k, i, j in zip(places, (4 * starts).tolist(), (4 * ends).tolist()):
            out[k] = data[i:j]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string()))

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of an Arrow array; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        maybe = np.flatnonzero(pc.match_substring(texts, self.opening).to_numpy(zero_copy_only=False))
        whole = {int(k): x for k in maybe if self.odd.search(x := texts[int(k)].as_py())}
        if whole:
            mask = np.zeros(len(texts), dtype=bool)
            mask[list(whole)] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), texts)
        words, bounds = cut_words(texts)
        words = words.dictionary_encode()
        codes, distinct = words.indices.to_numpy(), pc.ascii_ltrim(words.dictionary, " ")
        # Elsewhere an accent may follow: the library composes before it lower-cases, and some letters have one case only.
        distinct = pc.if_else(pc.string_is_ascii(distinct), pc.ascii_lower(distinct), distinct)
        found = self.encode_distinct(distinct.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(found), dtype=np.uint32)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        parts, ends = [], np.zeros(len(codes) + 1, dtype=np.int64)
        for i in range(0, len(codes), GATHERED):
            code = codes[i : i + GATHERED]
            n = lengths[code]
            end = np.cumsum(n)
            parts.append(ids[np.repeat(starts[code] - (end - n), n) + np.arange(end[-1])].tobytes())
            ends[i + 1 : i + 1 + len(code)] = end + ends[i]
        data = memoryview(b"".join(parts))
        at = (4 * ends[bounds]).tolist()
        out = [bytes(data[i:j]) for i, j in zip(at, at[1:])]
        if whole:
            for k, x in zip(whole, self.encode_whole(list(whole.values()))):
                out[k] = x
        return out


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(sizes: list[int], capacities: list[int]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Pieces (item, start, length) of each sequence, and (item, start) of what found no room."""
    room = np.array(capacities, dtype=np.int64)
    spent = np.zeros(len(capacities))
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in capacities]
    uncut = []
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        n = sizes[item]
        to = int(np.where(room >= n, spent, np.inf).argmin()) if len(room) else 0
        if not len(room) or room[to] < n:
            uncut.append(item)
            continue
        sequences[to].append((item, 0, n))
        room[to] -= n
        spent[to] += cost(n)
    left = []
    open_ = [int(k) for k in np.argsort(spent, kind="stable") if room[k] > 0]
    for item in uncut:
        start = 0
        while start < sizes[item] and open_:
            to = open_[0]
            n = min(int(room[to]), sizes[item] - start)
            sequences[to].append((item, start, n))
            room[to] -= n
            start += n
            if not room[to]:
                open_.pop(0)
        if start < sizes[item]:
            left.append((item, start))
    return sequences, left


class Packer:
    """Takes (identifier, ids) one by one; gives rows of pieces."""

    def __init__(self, capacity: int, buffer: int, first_sequence: int):
        self.capacity, self.buffer, self.next = capacity, buffer, first_sequence
        self.waiting: list[tuple[object, int, bytes, int]] = []  # identifier, start, ids, tokens of the document
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, identifier, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.capacity
        full = total // self.capacity
        for k in range(full):
            self._emit([(identifier, k * self.capacity, ids[k * width : (k + 1) * width], total)])
        if rest := ids[full * width :]:
            self.waiting.append((identifier, full * self.capacity, rest, total))
            self.tokens += len(rest) // 4
        if self.tokens >= self.buffer:
            self.pack([self.capacity] * (self.tokens // self.capacity))

    def finish(self) -> None:
        rest = self.tokens % self.capacity
        powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        self.pack([self.capacity] * (self.tokens // self.capacity) + powers)

    def pack(self, capacities: list[int]) -> None:
        items = self.waiting
        sequences, left = assign([len(x[2]) // 4 for x in items], capacities)
        for pieces in sequences:
            self._emit([(items[k][0], items[k][1] + start, items[k][2][4 * start : 4 * (start + n)], items[k][3]) for k, start, n in pieces])
        self.waiting = [(items[k][0], items[k][1] + start, items[k][2][4 * start :], items[k][3]) for k, start in left]
        self.tokens = sum(len(x[2]) // 4 for x in self.waiting)

    def _emit(self, pieces: list[tuple[object, int, bytes, int]]) -> None:
        if not pieces:
            return
        offset = 0
        for identifier, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((identifier, start, n, ids, total, self.next, offset))
            offset += n
        self.next += 1

    def taken(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    buffer_tokens: int = 512 * CAPACITY,
    keep_words: bool = True,
) -> DataFrame:
    """One row for each piece: identifier, start, length, ids, doc_tokens, sequence_id, offset.

    ids are little-endian unsigned 32-bit integers. `capacity` is a power of two. Null text is empty text:
    one piece of the end token; null or repeated identifiers are kept, each row is a document of its own;
    documents of equal size stand in the order of the input; an empty table gives no rows. Other columns are
    neither read nor returned. Without `keep_words` a Python worker remembers fewer words, lets go of them when
    a task ends and takes less text at a time: some are encoded again, but workers that other operators fill as well
    stay smaller.
    """
    _common.shipped(docs.sparkSession)
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [docs.schema[id_col].dataType, LongType(), LongType(), BinaryType(), LongType(), LongType(), LongType()]

    @_common.tidy
    def run(batches):
        words = bpe.loaded(WordTokens, tokenizer)
        words.remembered, most = (bpe.REMEMBERED, _common.PART_BYTES) if keep_words else (FEW_WORDS, FEW_BYTES)
        packer = Packer(capacity, buffer_tokens, TaskContext.get().partitionId() << 33)
        end = END_ID.to_bytes(4, "little")
        kinds = None

        def rows():
            columns = list(zip(*packer.taken())) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for i, texts in _common.array_parts(batch, 1, most):
                ids = batch.column(0).slice(i, len(texts)).to_pylist()
                for identifier, x in zip(ids, words.encode_array(texts)):
                    packer.add(identifier, x + end)
                yield rows()
        if kinds:
            packer.finish()
            yield rows()
        if not keep_words:
            words.forget()

    schema = StructType([StructField(n, t) for n, t in zip(names, types)])
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
