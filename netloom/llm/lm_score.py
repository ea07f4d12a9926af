"""Language-model scores from a log-frequency Bloom filter.

Training texts are counted in full: words, and pairs of adjacent words, the text's end being a word before
the first and after the last. A count c is quantised to level 1 + floor(log2 c); the filter holds the n-gram
once for each level up to its own. A probe asks for levels 1, 2, ... until one is absent and gives the mean
count of the last level present. Probabilities mix pair and word frequencies:

    P(w | v) = MIX * c(v w) / c(v) + (1 - MIX) * (c(w) + 1) / (N + V + 1)      (c from the filter; the
    first term at most MIX, and 0 for unseen v)

The filter holds every n-gram, whatever its count, and grows with them. It consists of 65,536 blocks, by the
first bits of the key, each sized by its own n-grams at LOAD; an n-gram has all its bits in one block.

Blocks aren't gathered anywhere: the n-grams go to them. Texts are read once, in slices of about SLICE words, and a
slice sends each n-gram that it has once, to one of BUCKETS ranges of blocks. There the counts of all slices
are added, the blocks filled and probed, and what each slice asked for goes back to it in the order of its keys: a
byte of level for an n-gram, and the exact count of a word (for n_tokens, n_known, base_score). The slice, which
waits as numbers of its words, gives the levels to its texts. So the work is in proportion to the texts, and no
task or driver holds more than a slice or CHUNK n-grams (or one range). Should two words share a 64-bit hash,
counting starts again with another seed.

Defined results: null text is the end alone; a null identifier counts as training; repeated identifiers are
kept, a row for each row; an empty table gives no rows, without training texts every count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from . import _common
from .language_id import fold

FILTER_BYTES, LOAD, HASHES = 1 << 26, 0.35, 3
BLOCKS, BLOCK_SHIFT = 1 << 16, 48
#: Ranges of whole blocks, dealt over tasks.
BUCKETS, BUCKET_SHIFT = 1 << 11, 53
MIX = 0.4
#: Words of text from which on a slice is full.
SLICE = 2_000_000
#: Partial counts from which on a task works out the ranges it has whole.
CHUNK = 1_000_000
END = b""
_LOW = np.uint64(2**32 - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def tokens(text: str | None) -> list[bytes]:
    out = text.encode().lower().split() if text else []
    out.append(END)
    return out


def word_key(h: np.ndarray) -> np.ndarray:
    return _mix(h + np.uint64(1))


def pair_key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _mix((before * _M1) ^ (h + np.uint64(2)))


def level(count):
    return np.floor(np.log2(count)).astype(np.int64) + 1


def _hasher(seed: int):
    import xxhash

    return lambda w: xxhash.xxh3_64_intdigest(w, seed)


def mean_count(levels: np.ndarray) -> np.ndarray:
    """A level holds counts from 2^(n-1) to 2^n - 1; 0 where level 1 is absent."""
    return np.where(levels > 0, (1.5 * np.exp2(levels - 1.0)) - 0.5, 0.0)


def block_of(keys: np.ndarray) -> np.ndarray:
    """Blocks are in the order of signed keys."""
    return (keys.view(np.int64) >> BLOCK_SHIFT) + BLOCKS // 2


def places(keys: np.ndarray, at_level: int, bits: np.ndarray) -> list[np.ndarray]:
    """The places of (key, level) pairs in blocks of so many bits (below 2^32)."""
    h = _mix(keys + np.uint64(at_level * 0x9E3779B97F4A7C15 % 2**64))
    low, step, m = h & _LOW, (h >> np.uint64(32)) | np.uint64(1), bits.astype(np.uint64)
    return [((((low + np.uint64(i) * step) & _LOW) * m) >> np.uint64(32)).astype(np.int64) for i in range(HASHES)]


def filled(keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, their sizes in bytes, their bytes one after another) for sorted keys."""
    block = block_of(keys)
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.ceil(np.add.reduceat(levels, starts) * (HASHES / LOAD / 8)).astype(np.int64)
    of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
    room, base = 8 * size[of], 8 * (np.cumsum(size) - size)[of]
    bits = np.zeros(8 * size.sum(), dtype=bool)
    at, n = np.arange(len(keys)), 1
    while len(at):
        for place in places(keys[at], n, room[at]):
            bits[base[at] + place] = True
        n += 1
        at = at[levels[at] >= n]
    return block[starts], size, np.packbits(bits, bitorder="little")


class LogFilter:
    """Bloom filter of (key, level) pairs over the blocks that it is given; other keys have level 0."""

    def __init__(self, blocks: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.data, self.size, self.base = data, np.zeros(BLOCKS, dtype=np.int64), np.zeros(BLOCKS, dtype=np.int64)
        self.size[blocks] = sizes
        self.base[blocks] = np.cumsum(sizes) - sizes

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level present of each key."""
        found = np.zeros(len(keys), dtype=np.uint8)
        block = block_of(keys)
        at = np.flatnonzero(self.size[block])
        k, base, room = keys[at], self.base[block[at]], 8 * self.size[block[at]]
        n = 1
        while len(at) and n < 64:
            here = np.ones(len(at), dtype=bool)
            for place in places(k, n, room):
                here &= (self.data[base + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
            at, k, base, room = at[here], k[here], base[here], room[here]
            found[at] = n
            n += 1
        return found


def probed(keys: np.ndarray, counts: np.ndarray, filter_bytes: int = FILTER_BYTES) -> np.ndarray:
    """The levels of distinct sorted keys of whole blocks in the filter of those counted, filled about filter_bytes at a time."""
    levels = np.zeros(len(keys), dtype=np.int64)
    levels[counts > 0] = level(counts[counts > 0])
    starts = np.flatnonzero(np.diff(block_of(keys), prepend=-1))
    size = np.add.reduceat(levels, starts) * (HASHES / LOAD / 8)
    run = (np.cumsum(size) - size) // filter_bytes
    found = np.zeros(len(keys), dtype=np.uint8)
    cuts = [*starts[np.flatnonzero(np.diff(run, prepend=-1))].tolist(), len(keys)]
    for i, j in zip(cuts, cuts[1:]):
        here = levels[i:j] > 0
        if here.any():
            found[i:j] = LogFilter(*filled(keys[i:j][here], levels[i:j][here])).levels(keys[i:j])
    return found


def order_of(keys: np.ndarray) -> np.ndarray:
    """An order that sorts signed keys. Sorting their first bits with their places behind them is faster than argsort."""
    bits = len(keys).bit_length()
    order = (keys >> bits << bits) | np.arange(len(keys))
    order.sort()
    order &= (1 << bits) - 1
    s = keys[order]
    wrong = np.flatnonzero(s[1:] < s[:-1])  # keys that differ in their last bits only
    if len(wrong) > 1000:
        return np.argsort(keys)
    for first in np.unique(s[wrong] >> bits).tolist():
        i, j = np.searchsorted(s >> bits, [first, first + 1])
        order[i:j] = order[i:j][np.argsort(s[i:j])]
    return order


def _heads(s: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), dtype=bool), s[1:] != s[:-1]]))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, their number in each), as by tokens()."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(texts, "", " "))  # the split ends with END
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _blobs(values, cuts: np.ndarray, width: int = 1) -> pa.Array:
    """Binary values that follow each other, cut at these places (in items of so many bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(values)])


def _flat(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(items of all binary values, the cuts between them)."""
    column = column.combine_chunks()
    width = np.dtype(dtype).itemsize
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, dtype=dtype), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].copy().view(dtype), (at - at[0]) // width


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers from 0 in bytes of 7 bits each, low ones first, all but the last marked by 128; the cuts between them)."""
    size, limit = np.ones(len(x), dtype=np.int64), 128
    while (more := x >= limit).any():
        size += more
        limit <<= 7
    cuts = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(cuts[-1], dtype=np.uint8)
    at, k = np.arange(len(x)), 0
    while len(at):
        more = size[at] > k + 1
        out[cuts[at] + k] = (x[at] >> 7 * k) & 127 | more.astype(np.int64) << 7
        at, k = at[more], k + 1
    return out, cuts


def decoded(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers, the cuts between numbers that stand at these cuts between bytes)."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    size, x = ends - starts, (data[starts] & 127).astype(np.int64)
    at, k = np.flatnonzero(size), 1
    while len(at):
        x[at] |= (data[starts[at] + k] & 127).astype(np.int64) << 7 * k
        k += 1
        at = at[size[at] >= k]
    return x, np.searchsorted(ends, cuts)


def narrowed(keys: np.ndarray, cuts: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps between sorted keys in as few bytes as a row's longest needs, the cuts between rows); a row's first step is from its range's start."""
    n, step = np.diff(cuts), np.diff(keys, prepend=0)
    first = cuts[:-1][n > 0]
    step[first] = keys[first] - (bucket[n > 0] - BUCKETS // 2 << BUCKET_SHIFT)
    width = np.zeros(len(n), dtype=np.int64)
    width[n > 0] = (np.frexp(np.maximum.reduceat(step, first).astype(float))[1] + 7) // 8 if len(first) else 0
    width[n > 0] = np.maximum(width[n > 0], 1)
    out = np.empty((n * width).sum(), dtype=np.uint8)
    for w in np.unique(width[n > 0]).tolist():
        here = width == w
        out[np.repeat(here, n * width)] = step[np.repeat(here, n)].view(np.uint8).reshape(-1, 8)[:, :w].ravel()
    return out, np.concatenate([[0], np.cumsum(n * width)])


def widened(data: np.ndarray, of_bytes: np.ndarray, of_keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The keys of rows of narrowed() that are cut at these bytes and keys."""
    n = np.diff(of_keys)
    width = np.diff(of_bytes) // np.maximum(n, 1)
    step = np.empty(of_keys[-1], dtype=np.int64)
    for w in np.unique(width[n > 0]).tolist():
        here = width == w
        part = (data if here.all() else data[np.repeat(here, np.diff(of_bytes))]).reshape(-1, w)
        wide = np.zeros((len(part), 8), dtype=np.uint8)
        wide[:, :w] = part
        step[np.repeat(here, n)] = wide.view(np.int64).ravel()
    keys = np.cumsum(step)  # may pass 64 bits; the differences are right
    before = np.concatenate([[0], keys])[of_keys[:-1]]
    keys += np.repeat((bucket - BUCKETS // 2 << BUCKET_SHIFT) - before, n)
    return keys


def _pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the pairs of a slice; it ends with END, which is the word before each first one."""
    return pair_key(h[np.concatenate([at[-1:], at[:-1]])], h[at]).view(np.int64)


# Rows of a slice, first by range of blocks, then by slice. n-grams in the order of their keys: the words, each with a line
# feed, the keys of pairs (narrowed), and how often they are in the slice (coded). Answers: levels (8 bits) and, of words,
# counts (coded), their number in the slice as it came, and hashes. Texts, which have the answers before them (rank):
# numbers of their words (coded), counted from the most frequent one of the slice.
_ASKED = [(n, BinaryType()) for n in ("word", "word_n", "pair_key", "pair_n")]
_ANSWERS = [(n, BinaryType()) for n in ("words", "counts", "word_n", "hashes", "pairs")]
_TOTALS = [("total", LongType()), ("distinct", LongType()), ("clash", BooleanType())]
_EDGES = np.arange(1, BUCKETS, dtype=np.int64) - BUCKETS // 2 << BUCKET_SHIFT


def _row(id_type, *more: list) -> StructType:
    fixed = [("slice", LongType()), ("rank", IntegerType()), ("id", id_type), ("held", BooleanType()), ("data", BinaryType())]
    return StructType([StructField(n, t) for n, t in [x for part in (fixed, *more) for x in part]])


def _batch(rows: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch whose other columns are null."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _asking(seed: int, slice_words: int, schema: StructType):
    def run(batches):
        _common.worker_memory("lm_score")
        hash_of, to = _hasher(seed), to_arrow_schema(schema)
        task, made = TaskContext.get().partitionId(), 0
        held = {False: [], True: []}

        def flush(outside: bool):
            nonlocal made
            number = task << 32 | made
            made += 1
            spelt = pa.chunked_array([x for x, _, _ in held[outside]]).dictionary_encode()
            sizes, ids = np.concatenate([x for _, x, _ in held[outside]]), pa.concat_arrays([x for _, _, x in held[outside]])
            held[outside] = []
            at = np.concatenate([x.indices.to_numpy() for x in spelt.chunks])
            word = spelt.chunk(0).dictionary.cast(pa.binary())
            del spelt
            h = np.fromiter(map(hash_of, word.to_pylist()), dtype=np.uint64, count=len(word))
            key = word_key(h).view(np.int64)
            order = np.argsort(key)
            key, h, word_n = key[order], h[order], np.bincount(at, minlength=len(word))[order]
            word = pc.binary_join_element_wise(word.take(pa.array(order)), b"", b"\n")
            place = np.empty(len(h), dtype=np.int64)
            place[order] = np.arange(len(h))
            at = place[at]
            pair = _pairs(h, at)
            pair.sort()
            heads = _heads(pair)
            pair_n, pair = np.diff(heads, append=len(pair)), pair[heads]
            of_words, of_pairs = (np.concatenate([[0], np.searchsorted(x, _EDGES), [len(x)]]) for x in (key, pair))
            bucket = np.flatnonzero(np.diff(of_words) + np.diff(of_pairs))
            of_words, of_pairs = (np.append(x[bucket], x[-1]) for x in (of_words, of_pairs))
            word_at = np.frombuffer(word.buffers()[1], dtype=np.int32)[of_words]
            steps, cuts_steps = narrowed(pair, of_pairs, bucket)
            (n_words, cuts_words), (n_pairs, cuts_pairs) = coded(word_n), coded(pair_n)
            asked = _batch(
                len(bucket), to, range=pa.array(bucket.astype(np.int32)), slice=pa.array(np.full(len(bucket), number)), held=pa.array(np.full(len(bucket), outside)),
                word=_blobs(word.buffers()[2] or b"", word_at), word_n=_blobs(n_words, cuts_words[of_words]),
                pair_key=_blobs(steps, cuts_steps), pair_n=_blobs(n_pairs, cuts_pairs[of_pairs]),
            )
            for i in range(0, len(bucket), 512):
                yield asked.slice(i, 512)
            place[_numbered(word_n)] = np.arange(len(h))
            data, cuts = coded(place[at])
            rank = np.arange(len(sizes))
            texts = _batch(
                len(sizes), to, range=pa.array((BUCKETS + rank % BUCKETS).astype(np.int32)), slice=pa.array(np.full(len(sizes), number)),  # texts go to any task
                rank=pa.array(rank.astype(np.int32)), id=ids, held=pa.array(np.full(len(sizes), outside)), data=_blobs(data, cuts[np.concatenate([[0], np.cumsum(sizes)])]),
            )
            for i in range(0, len(sizes), 512):
                yield texts.slice(i, 512)

        for batch in batches:
            ids, outside = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for i, texts in _common.array_parts(batch, 1, min(_common.PART_BYTES, 4 * slice_words)):
                here = outside[i : i + len(texts)]
                for x in np.unique(here).tolist():
                    mask = pa.array(here == x)
                    held[x].append((*split(texts.filter(mask)), ids.slice(i, len(texts)).filter(mask)))
                    if sum(len(words) for words, _, _ in held[x]) >= slice_words:
                        yield from flush(x)
        for x in held:
            if held[x]:
                yield from flush(x)

    return _common.tidy(run)


def _numbered(word_n: np.ndarray) -> np.ndarray:
    """The words of a slice, given in the order of their keys, from the most frequent one on."""
    return np.argsort(-word_n, kind="stable")


def _answered(rows: pa.Table, hash_of, filter_bytes: int, to: pa.Schema):
    """The answers to rows of whole ranges, and a row of totals."""
    range_, training = rows.column("range").to_numpy().astype(np.int64), ~rows.column("held").to_numpy()
    word_n, of_words = decoded(*_flat(rows.column("word_n"), np.uint8))
    pair_n, of_pairs = decoded(*_flat(rows.column("pair_n"), np.uint8))
    word = _flat(rows.column("word"), np.uint8)[0].tobytes().split(b"\n")[:-1]
    h = np.fromiter(map(hash_of, word), dtype=np.uint64, count=len(word))
    keys = np.concatenate([word_key(h).view(np.int64), widened(*_flat(rows.column("pair_key"), np.uint8), of_pairs, range_)])
    n = np.concatenate([x * np.repeat(training, np.diff(cuts)) for x, cuts in ((word_n, of_words), (pair_n, of_pairs))])
    order = order_of(keys)
    s = keys[order]
    heads = _heads(s)
    found = probed(s[heads].view(np.uint64), np.add.reduceat(n[order], heads), filter_bytes)
    levels = np.empty(len(keys), dtype=np.uint8)
    levels[order] = np.repeat(found, np.diff(heads, append=len(keys)))
    # Words alone, exactly.
    words = len(word)
    mine = order < words
    order, s = order[mine], s[mine]
    heads = _heads(s)
    count = np.add.reduceat(n[order], heads) if words else np.empty(0, dtype=np.int64)
    counts = np.empty(words, dtype=np.int64)
    counts[order] = np.repeat(count, np.diff(heads, append=words))
    word = np.array(word, dtype=object)[order]
    same = s[1:] == s[:-1]
    clash = bool((word[1:][same] != word[:-1][same]).any())
    counts, cuts = coded(counts)
    yield _batch(
        rows.num_rows, to, slice=rows.column("slice").combine_chunks(), rank=pc.subtract(rows.column("range"), pa.scalar(BUCKETS, pa.int32())).combine_chunks(),
        words=_blobs(levels, of_words), counts=_blobs(counts, cuts[of_words]), word_n=rows.column("word_n").combine_chunks(), hashes=_blobs(h, of_words, 8),
        pairs=_blobs(levels[words:], of_pairs),
    )
    yield _batch(1, to, slice=pa.array([-1]), rank=pa.array([0], pa.int32()), total=pa.array([count.sum()]), distinct=pa.array([(count > 0).sum()]), clash=pa.array([clash]))


def _answering(seed: int, filter_bytes: int, schema: StructType):
    def run(batches):
        _common.worker_memory("lm_score")
        hash_of, to = _hasher(seed), to_arrow_schema(schema)
        held: list[pa.RecordBatch] = []
        asked, goal = 0, CHUNK
        for batch in batches:
            range_ = batch.column(batch.schema.get_field_index("range")).to_numpy()
            k = int(np.searchsorted(range_, BUCKETS))
            if k < len(range_):
                rest = batch.slice(k)
                yield _batch(rest.num_rows, to, **{n: rest.column(rest.schema.get_field_index(n)) for n in ("slice", "rank", "id", "held", "data")})
            if not k:
                continue
            held.append(batch.slice(0, k))
            asked += _asks(held[-1])
            if asked >= goal:
                rows = pa.Table.from_batches(held)
                range_ = rows.column("range").to_numpy()
                cuts = _pieces(range_, rows)
                for i, j in zip(cuts, cuts[1:]):
                    yield from _answered(rows.slice(i, j - i), hash_of, filter_bytes, to)
                held = rows.slice(cuts[-1]).to_batches()
                asked = sum(map(_asks, held))
                goal = max(CHUNK, 2 * asked)
        if held:
            rows = pa.Table.from_batches(held)
            cuts = [*_pieces(rows.column("range").to_numpy(), rows), rows.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                yield from _answered(rows.slice(i, j - i), hash_of, filter_bytes, to)

    return _common.tidy(run)


def _asks(rows) -> int:
    """About the number of n-grams: most numbers of words and pairs take a byte."""
    return sum(pc.sum(pc.binary_length(rows.column(rows.schema.get_field_index(n)))).as_py() for n in ("word_n", "pair_n"))


def _pieces(range_: np.ndarray, rows: pa.Table) -> list[int]:
    """Cuts between runs of ranges with about CHUNK n-grams each; the last range may not be whole and comes after the last cut."""
    heads = _heads(range_)
    size = sum(pc.binary_length(rows.column(n)).to_numpy().astype(np.int64) for n in ("word_n", "pair_n"))
    size = np.add.reduceat(size, heads)
    run = (np.cumsum(size) - size) // CHUNK
    first = np.diff(run, prepend=-1) != 0
    first[-1] = True
    return heads[first].tolist()


def _assembling(schema: StructType):
    """The levels of each text's words and pairs, and what doesn't depend on totals."""

    def run(batches):
        _common.worker_memory("lm_score")
        to = to_arrow_schema(schema)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = [*_heads(number).tolist(), len(number)]
            for i, j in zip(cuts, cuts[1:]):
                part = batch.slice(i, j - i)
                if number[i] < 0:
                    yield _batch(j - i, to, **{n: part.column(part.schema.get_field_index(n)) for n, _ in _TOTALS})
                    continue
                if held and held[0].column(0)[0].as_py() != number[i]:
                    yield from assembled(pa.Table.from_batches(held), to)
                    held = []
                held.append(part)
        if held:
            yield from assembled(pa.Table.from_batches(held), to)

    def assembled(rows: pa.Table, to: pa.Schema):
        k = int(np.searchsorted(rows.column("rank").to_numpy(), 0))
        answers, texts = rows.slice(0, k), rows.slice(k)
        at, cuts = decoded(*_flat(texts.column("data"), np.uint8))
        starts, sizes = cuts[:-1], np.diff(cuts)
        (word_n, _), (count, _) = (decoded(*_flat(answers.column(n), np.uint8)) for n in ("word_n", "counts"))
        h, word = (_flat(answers.column(n), t)[0] for n, t in (("hashes", np.uint64), ("words", np.uint8)))
        order = _numbered(word_n)
        h, word, count = h[order], word[order], count[order]
        pair = _pairs(h, at)
        order = order_of(pair)
        heads = _heads(pair[order])
        both = np.empty(len(at), dtype=np.uint8)
        both[order] = np.repeat(_flat(answers.column("pairs"), np.uint8)[0], np.diff(heads, append=len(at)))
        add = lambda x: pa.array(np.add.reduceat(x[at], starts))
        out = _batch(
            len(sizes), to, id=texts.column("id").combine_chunks(), held=texts.column("held").combine_chunks(), n_tokens=pa.array(sizes),
            n_known=add((count > 0).astype(np.int64)), base=add(np.log10(count + 1)), words=_blobs(word[at], cuts), pairs=_blobs(both, cuts),
        )
        for i in range(0, len(sizes), 512):
            yield out.slice(i, 512)

    return _common.tidy(run)


def _scoring(total: int, distinct: int, schema: StructType):
    def run(batches):
        _common.worker_memory("lm_score")
        to, size = to_arrow_schema(schema), total + distinct + 1
        # By levels of pair, word before and word (below 64 each).
        both, before, word = (mean_count(np.arange(64.0)).reshape(x) for x in ((-1, 1, 1), (-1, 1), (-1,)))
        p = MIX * np.minimum(1.0, both / np.maximum(before, 1.0)) * (before > 0)
        of = np.log10(p + (1 - MIX) * (word + 1) / size).ravel()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            (word, cuts), (both, _) = (_flat(rows.column(n), np.uint8) for n in ("words", "pairs"))
            at = both.astype(np.int32) << 12 | np.concatenate([word[-1:], word[:-1]]).astype(np.int32) << 6 | word
            base = rows.column("base").to_numpy() - rows.column("n_tokens").to_numpy() * np.log10(size)
            kept = {n: batch.column(batch.schema.get_field_index(n)) for n in ("id", "held", "n_tokens", "n_known")}
            yield _batch(batch.num_rows, to, **kept, base_score=pa.array(base), score=pa.array(np.add.reduceat(of[at], cuts[:-1])))

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, filter_bytes: int = FILTER_BYTES, slice_words: int = SLICE) -> DataFrame:
    """identifier, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    _common.shipped(spark)
    held = F.coalesce(fold(id_col, folds) == held_fold, F.lit(False))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    id_type = docs.schema["id"].dataType
    asked, answers = _row(id_type, [("range", IntegerType()), *_ASKED]), _row(id_type, _ANSWERS, _TOTALS)
    own = [("id", id_type), ("held", BooleanType()), ("n_tokens", LongType()), ("n_known", LongType())]
    texts, scores = (StructType([StructField(n, t) for n, t in [*own, *x]]) for x in ([("base", DoubleType()), _ANSWERS[0], _ANSWERS[-1], *_TOTALS], [("base_score", DoubleType()), ("score", DoubleType())]))
    for seed in range(8):
        rows = docs.mapInArrow(_asking(seed, slice_words, asked), asked).repartition("range").sortWithinPartitions("range")
        rows = rows.mapInArrow(_answering(seed, filter_bytes, answers), answers).repartition("slice").sortWithinPartitions("slice", "rank")
        path = f"{_common.work_dir(spark)}/model"
        rows.mapInArrow(_assembling(texts), texts).write.option("compression", "zstd").parquet(path)  # levels have few values
        model = spark.read.schema(texts).parquet(path)
        total, distinct, clash = model.where("total is not null").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.max("clash"), F.lit(False))).first()
        if not clash:
            break
    else:
        raise RuntimeError("lm_score: two words share a hash under each of 8 seeds")
    out = model.where("total is null").mapInArrow(_scoring(total, distinct, scores), scores)
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
