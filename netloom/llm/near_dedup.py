"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct word shingles. Equal sets are one vertex. Every vertex is branched down
TREES independent trees: at each node it goes to the child named by the token of its set that is least under
the node's own minwise function (the topmost levels make one key, by which Spark deals the vertices to
tasks). Nodes of at most SMALL vertices are compared exhaustively on two-bit sketches of all minwise values;
larger ones branch on, and at the deepest level the vertices of a node are compared with pivots. A node with
few similar pairs reports all of them; a dense one reports a spanning forest and its members. All reported
pairs are confirmed on full sets. Once the components of the confirmed links are known, dense nodes report
the similar pairs that these components don't join: in a first round the best one of each vertex, in a
second one all that are left. Those of the second round pass a test on the PREFIX least shingle hashes of both
sets before they leave their node, else a node of texts slightly below the similarity would list all its pairs.
All are confirmed as well: what isn't looked at are pairs inside one component, whose links change no result.

Hot keys: a key of more than HOT vertices is dealt by all levels instead; a node that is still larger is split
into blocks of about HOT vertices, and every pair of blocks is a node of its own. So a task holds 2 * HOT members
of a node at a time, and no pair is lost. The work on such a node is quadratic in its distinct sets.

Recall: a pair of similarity s is in a common node of depth d with probability s^d for each tree, so a pair
at 0.8 is missed in 16 trees with (1 - 0.64)^16 = 8e-8 at depth 2, 2e-4 at depth 4, but 5e-2 at depth 8. The
deepest level is the last at which a pair of the least similarity is missed with MISSED at most, whatever the
size of the nodes (depth 4 at 0.8, 1 at 0.5; below 0.36 none, and such a similarity is refused); what a node has
beyond costs time, not pairs. The sketch comparison asks for the agreements expected at the least similarity
less 4.66 deviations, which loses a pair at that similarity with a probability of about 1e-6; the prefix test
loses none of sets that fit the prefix, and one of longer sets where the estimate is six deviations too low (1e-9).

Defined results: null and blank texts have an empty set, are linked with nothing and stay; a null identifier
is smaller than any other and is returned as null; rows repeating an identifier are rows of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from netloom.operators.components import components

from . import _common
from .exact_dedup import DigestFilter

TREES, LEVELS, SMALL = 16, 8, 256
FUNCTIONS = TREES * LEVELS
#: Share of the pairs of the least similarity that branching may miss.
MISSED = 1e-3
#: Vertices of a key from which on it is split.
HOT = 4096
#: Shingle hashes of each vertex that the second round has in a node: 8 KB at most.
PREFIX = 1024

_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


class Words:
    """64-bit hashes of words; frequent ones are remembered."""

    def __init__(self):
        import xxhash

        self.hash, self.known = xxhash.xxh3_64_intdigest, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known = self.known = {}
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str | None, width: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence is one where it is shorter."""
    h = words(text.encode().lower().split()) if text else np.empty(0, dtype=np.uint64)
    if not len(h):
        return h
    n = min(width, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = _mix(out * _M1 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """FUNCTIONS minima for each (non-empty) set."""
    flat = np.concatenate(sets)
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), FUNCTIONS), dtype=np.uint32)
    for k in range(FUNCTIONS):
        h = x * _MULTIPLY[k] + _ADD[k]
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def two_bits(mins: np.ndarray) -> np.ndarray:
    """Two hashed bits of every minimum, packed to 64-bit words."""
    bits = (mins * np.uint32(2246822519)) >> np.uint32(30)
    out = np.zeros((len(mins), FUNCTIONS // 32), dtype=np.uint64)
    for k in range(FUNCTIONS):
        out[:, k // 32] |= bits[:, k].astype(np.uint64) << np.uint64(2 * (k % 32))
    return out


def depths(percent: int) -> tuple[int, int]:
    """Levels of the key, and the deepest level whose recall is enough."""
    enough = [d for d in range(1, LEVELS + 1) if (1 - (percent / 100) ** d) ** TREES <= MISSED]
    if not enough:
        raise ValueError(f"near_dedup: {TREES} trees don't find pairs of {percent} % surely enough")
    return min(2, max(enough)), max(enough)


def least_agreement(percent: int) -> int:
    """Two-bit agreements of FUNCTIONS that a pair needs; at 80 % 108.8 are expected, with a deviation of 4."""
    q = 0.25 + 0.75 * percent / 100
    return math.ceil(FUNCTIONS * q - 4.66 * math.sqrt(FUNCTIONS * q * (1 - q)))


def similar(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a and b agree on enough sketch bits and have sizes that allow the similarity."""
    return agreement(a, na, b, nb, percent) > 0


def agreement(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Agreeing sketch values of the rows of a and b; 0 where too few or the sizes forbid the similarity."""
    agree = np.full((len(a), len(b)), FUNCTIONS, dtype=np.int16)
    for w in range(a.shape[1]):
        x = a[:, w, None] ^ b[None, :, w]
        agree -= np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).astype(np.int16)
    low, high = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    return np.where((agree >= least_agreement(percent)) & (100 * low >= percent * high), agree, 0)


def node_keys(mins: np.ndarray, top: int) -> np.ndarray:
    """The key of each tree: a hash of the tree and its `top` first tokens."""
    out = np.empty((len(mins), TREES), dtype=np.int64)
    for t in range(TREES):
        key = np.full(len(mins), t, dtype=np.uint64)
        for k in range(top):
            key = _mix(key * _M1 + mins[:, t * LEVELS + k].astype(np.uint64) + np.uint64(1))
        out[:, t] = key.view(np.int64)
    return out


class Node:
    """Compares the vertices of the nodes below one key; rows are (a, b) pairs and (node, vertex) members."""

    def __init__(self, percent: int):
        self.percent = percent
        self.deepest = depths(percent)[1]
        self.pairs: list[tuple[bytes, bytes]] = []
        self.members: list[tuple[int, bytes, int, bytes]] = []

    def split(self, key: int, depth: int, ids: list[bytes], n: np.ndarray, tokens: np.ndarray, bits: np.ndarray) -> None:
        todo = [(np.arange(len(ids)), depth, key)]
        while todo:
            at, depth, name = todo.pop()
            if len(at) < 2:
                continue
            if len(at) <= SMALL:
                self.compare(name, at, ids, n, bits)
            elif depth == self.deepest:
                self.pivots(name, at, ids, n, bits)
            else:
                values, inverse = np.unique(tokens[at, depth], return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                cuts = np.searchsorted(inverse[order], np.arange(len(values) + 1))
                for v, x, y in zip(values.tolist(), cuts, cuts[1:]):
                    child = int(_mix(np.array([(name & (2**64 - 1)) ^ (v + depth * 2**40)], dtype=np.uint64)).view(np.int64)[0])
                    todo.append((at[order[x:y]], depth + 1, child))

    def compare(self, name, at, ids, n, bits) -> None:
        """Exhaustively; at most SMALL vertices."""
        x, y = np.nonzero(np.triu(similar(bits[at], n[at], bits[at], n[at], self.percent), 1))
        if len(x) > 4 * len(at):
            _, first = np.unique(y, return_index=True)  # for each vertex the first that it is similar to
            self._keep(name, at[np.unique(np.concatenate([x, y]))], ids, n, bits)
            x, y = x[first], y[first]
        self.pairs += [(ids[at[i]], ids[at[j]]) for i, j in zip(x.tolist(), y.tolist())]

    def pivots(self, name, at, ids, n, bits) -> None:
        """A large node: the first vertex takes all similar ones, and so on with the rest."""
        self._keep(name, at, ids, n, bits)
        rest = at
        while len(rest) > 1:
            pivot, rest = rest[0], rest[1:]
            hit = similar(bits[pivot : pivot + 1], n[pivot : pivot + 1], bits[rest], n[rest], self.percent)[0]
            self.pairs += [(ids[pivot], ids[k]) for k in rest[hit].tolist()]
            rest = rest[~hit]

    def _keep(self, name, at, ids, n, bits) -> None:
        self.members += [(name, ids[k], int(n[k]), bits[k].tobytes()) for k in at.tolist()]

    def rows(self) -> pa.RecordBatch:
        pairs, members = self.pairs, self.members
        self.pairs, self.members = [], []
        none = [None] * len(pairs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs] + [m[1] for m in members], pa.binary()),
                pa.array([p[1] for p in pairs] + [None] * len(members), pa.binary()),
                pa.array(none + [m[0] for m in members], pa.int64()),
                pa.array(none + [m[2] for m in members], pa.int32()),
                pa.array(none + [m[3] for m in members], pa.binary()),
            ],
            ["a", "b", "node", "n", "bits"],
        )


_FOUND = StructType([StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("node", LongType()), StructField("n", IntegerType()), StructField("bits", BinaryType())])


def _runs(batches):
    """Batches of rows sorted by their first column, dealt anew so that no key is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        held.append(batch)
        if key[0] == key[-1] and len(held) > 1 and held[0].column(0)[0].as_py() == key[0]:
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut == 0 and len(held) == 1:
            continue
        held[-1] = batch.slice(0, cut)
        yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, tag: Column | None) -> DataFrame:
    """Of every row the size of its set, and of those that have one its digest, minima, sketch and keys."""
    top = depths(percent)[0]

    @_common.tidy
    def run(batches):
        _common.worker_memory("near_dedup")
        words = Words()
        for batch in batches:
            for i, texts in _common.text_parts(batch, 3, 1_000_000):
                sets = [shingles(x, width, words) for x in texts]
                full = [s for s in sets if len(s)]
                mins = minwise(full) if full else np.empty((0, FUNCTIONS), dtype=np.uint32)
                own, bits, keys = iter(mins), iter(two_bits(mins)), iter(node_keys(mins, top))
                of = lambda rows: pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(i, len(texts)) for k in range(3)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        of(own),
                        of(bits),
                        pa.array([next(keys).tolist() if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names,
                )

    fields = [("_id", LongType()), ("_no_id", BooleanType()), ("_tag", BinaryType()), ("_size", IntegerType()), ("_set", BinaryType()), ("_mins", BinaryType()), ("_bits", BinaryType()), ("_keys", ArrayType(LongType()))]
    names = [n for n, _ in fields]
    own = (tag if tag is not None else F.lit(None)).cast("binary").alias("_tag")
    rows = docs.select(_common.row_key(id_col).alias("_id"), F.col(id_col).isNull().alias("_no_id"), own, text_col)
    return rows.mapInArrow(run, StructType([StructField(n, t) for n, t in fields]))


def _dealt(vertices: DataFrame, percent: int, where: str) -> DataFrame:
    """(key, depth, id, n, tokens, bits) of every vertex in every tree; hot keys split as the module says."""
    top, deepest = depths(percent)
    tree = vertices.select("_set", "_size", "_mins", "_bits", F.posexplode("_keys").alias("_tree", "key"))
    tokens = F.substring("_mins", F.col("_tree") * (4 * LEVELS) + 1, F.lit(4 * LEVELS))
    rows = tree.select("key", F.lit(top).alias("depth"), F.col("_set").alias("id"), F.col("_size").alias("n"), tokens.alias("tokens"), F.col("_bits").alias("bits"))
    sizes = vertices.select(F.explode("_keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT)
    hot = _common.written(sizes.select("key"), f"{where}/hot")
    if hot.isEmpty():
        return rows
    further = F.xxhash64("key", F.substring("tokens", 4 * top + 1, 4 * (deepest - top)))
    deep = _common.written(rows.join(hot, "key", "left_semi").withColumns({"key": further, "depth": F.lit(deepest)}), f"{where}/deep")
    blocks = deep.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key", F.ceil(F.col("rows") / HOT).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    both = deep.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other")))
    return rows.join(hot, "key", "left_anti").unionByName(both.withColumn("key", named).select(*rows.columns))


def _branched(dealt: DataFrame, percent: int) -> DataFrame:
    """Similar pairs and members of dense nodes over all trees."""

    @_common.tidy
    def run(batches):
        _common.worker_memory("near_dedup")
        node = Node(percent)
        for table in _runs(batches):
            key = table.column(0).to_numpy()
            same = key[1:] == key[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if not shared.any():
                continue
            table, key = table.filter(pa.array(shared)), key[shared]
            depth = table.column(1).to_numpy()
            ids = table.column(2).to_pylist()
            n = table.column(3).to_numpy()
            tokens = np.frombuffer(b"".join(table.column(4).to_pylist()), dtype=np.uint32).reshape(-1, LEVELS)
            bits = np.frombuffer(b"".join(table.column(5).to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for x, y in zip(cuts, cuts[1:]):
                node.split(int(key[x]), int(depth[x]), ids[x:y], n[x:y], tokens[x:y], bits[x:y])
            yield node.rows()

    return dealt.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, _FOUND)


class Prefixes:
    """The least shingle hashes of a node's vertices, each sorted; estimates of similarities from them."""

    def __init__(self, prefixes: list[bytes], percent: int):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in prefixes]
        size = np.array([len(x) for x in sets])
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.none, self.p = len(values), percent / 100
        self.rows = np.full((len(sets), size.max()), self.none, dtype=np.int32)
        self.rows[np.arange(size.max()) < size[:, None]] = code
        #: Up to this value the prefix has all of the set.
        self.upto = np.where(size < PREFIX, self.none - 1, self.rows[np.arange(len(sets)), size - 1])
        self.mark = np.zeros(self.none + 1, dtype=bool)

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may have the similarity with one."""
        own = self.rows[one]
        self.mark[own] = True
        self.mark[self.none] = False
        kept = []
        for i in range(0, len(others), 1024):
            at = others[i : i + 1024]
            rows, limit = self.rows[at], np.minimum(self.upto[one], self.upto[at])[:, None]
            both = (self.mark[rows] & (rows <= limit)).sum(axis=1)
            union = (own <= limit).sum(axis=1) + (rows <= limit).sum(axis=1) - both
            margin = np.where(limit[:, 0] == self.none - 1, 1e-9, 6 * np.sqrt(self.p * (1 - self.p) / union))
            kept.append(at[both >= (self.p - margin) * union])
        self.mark[own] = False
        return np.concatenate(kept)


def _unjoined(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """Similar pairs of different components inside dense nodes; members: (node, a, n, bits, component, prefix).

    With `best`, each vertex outside the node's largest component gives its pair of the best agreement only;
    without, every pair that the prefixes don't rule out.
    """

    @_common.tidy
    def run(batches):
        for table in _runs(batches):
            key = table.column(0).to_numpy()
            ids, part = table.column(1).to_pylist(), table.column(4).to_pylist()
            n = table.column(2).to_numpy()
            bits = np.frombuffer(b"".join(table.column(3).to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            names = {c: k for k, c in enumerate(dict.fromkeys(part))}
            code = np.array([names[c] for c in part])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for x, y in zip(cuts, cuts[1:]):
                values, sizes = np.unique(code[x:y], return_counts=True)
                if len(values) < 2:
                    continue
                most = values[sizes.argmax()]
                others = x + np.flatnonzero(code[x:y] != most)  # each against the whole node
                pairs: set[tuple[bytes, bytes]] = set()
                prefixes = None if best else Prefixes(table.column(5).slice(x, y - x).to_pylist(), percent)
                for i in range(0, len(others), 64):
                    rows = others[i : i + 64]
                    hit = agreement(bits[rows], n[rows], bits[x:y], n[x:y], percent) * (code[rows][:, None] != code[None, x:y])
                    if best:  # one partner: agreement ties are frequent, the first of them will do
                        top = hit.argmax(axis=1)
                        only = np.zeros_like(hit)
                        only[np.arange(len(hit)), top] = hit[np.arange(len(hit)), top]
                        hit = only
                    for r in np.flatnonzero(hit.any(axis=1)).tolist():
                        near = np.flatnonzero(hit[r])
                        for c in (near if best else prefixes.near(rows[r] - x, near)).tolist():
                            u, v = ids[rows[r]], ids[x + c]
                            pairs.add((u, v) if u < v else (v, u))
                    if len(pairs) > 100_000:
                        yield _pairs(pairs)
                        pairs = set()
                yield _pairs(pairs)

    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])
    return members.select("node", "a", "n", "bits", "component", "prefix").repartition("node").sortWithinPartitions("node", "a").mapInArrow(run, schema)


def _pairs(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def _full_sets(docs: DataFrame, id_col: str, text_col: str, width: int, vertices: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """(_vertex, _full) of the vertices in pairs, from the texts of their least documents."""
    wanted = pairs.select(F.col("a").alias("_set")).unionByName(pairs.select(F.col("b").alias("_set"))).distinct()
    ids = vertices.join(wanted, "_set", "left_semi").select("_id")
    filtered = DigestFilter(_common.written(ids, f"{path}-ids"), "_id", path)

    @_common.tidy
    def run(batches):
        _common.worker_memory("near_dedup")
        words = Words()
        for batch in batches:
            for _, texts in _common.text_parts(batch, 1, 1_000_000):
                full = [s.tobytes() for s in (shingles(x, width, words) for x in texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in full], pa.binary()), pa.array(full, pa.binary())], ["_vertex", "_full"]
                )

    schema = StructType([StructField("_vertex", BinaryType()), StructField("_full", BinaryType())])
    rows = filtered.maybe_in(docs.select(_common.row_key(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id")
    # Written, so that both sides of the joins by vertex are shuffled for them and hot vertices can be split.
    return _common.written(rows.select("_id", "_text").mapInArrow(run, schema).dropDuplicates(["_vertex"]), f"{path}-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""

    @_common.tidy
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            kept = []
            for k in range(batch.num_rows):
                u, v = np.frombuffer(x[k].as_py(), dtype=np.uint64), np.frombuffer(y[k].as_py(), dtype=np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                kept.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])
    left = sets.select(F.col("_vertex").alias("a"), F.col("_full").alias("_x"))
    right = sets.select(F.col("_vertex").alias("b"), F.col("_full").alias("_y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", "_x", "_y").mapInArrow(run, schema)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, tag: Column | None = None) -> DataFrame:
    """One row for each row: identifier, n_shingles, component_id (least identifier reachable), kept; and _tag if given."""
    spark = docs.sparkSession
    _common.shipped(spark)
    where = _common.work_dir(spark)
    _common.check_id(docs, id_col)
    rows = _common.written(_sketches(docs, id_col, text_col, width, percent, tag), f"{where}/sketches")
    sets = rows.where(F.col("_set").isNotNull())
    # The least identifier names the vertex; the partial minimum collapses large groups before the shuffle.
    least = sets.groupBy("_set").agg(F.min(F.struct("_id", "_size", "_mins", "_bits", "_keys")).alias("_v"))
    ones = _common.written(least.select("_set", "_v.*"), f"{where}/vertices")
    vertices = ones.select("_set", "_id")

    found = _common.written(_branched(_dealt(ones, percent, where), percent), f"{where}/found")
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = _common.written(pair(found.where(F.col("b").isNotNull())), f"{where}/pairs")
    full = _full_sets(docs, id_col, text_col, width, vertices, tested, f"{where}/wanted")
    links = _common.written(_confirmed(tested, full, percent), f"{where}/links")
    labels = components(links)

    members = found.where(F.col("node").isNotNull())
    # First the most promising pairs, which join most components; then every pair that is left.
    for k, best in enumerate((True, False)):
        inside = members.join(labels, F.col("a") == F.col("vertex"), "left").withColumn("component", F.coalesce("component", "a"))
        if best:
            inside = inside.withColumn("prefix", F.lit(None).cast("binary"))
        else:
            inside = _common.written(inside.select("node", "a", "n", "bits", "component"), f"{where}/inside")
            split = inside.groupBy("node").agg(F.min(F.xxhash64("component")).alias("_x"), F.max(F.xxhash64("component")).alias("_y"))
            inside = inside.join(split.where(F.col("_x") != F.col("_y")).select("node"), "node", "left_semi")
            full = _full_sets(docs, id_col, text_col, width, vertices, inside.select("a", F.col("a").alias("b")), f"{where}/wanted-{k}")
            prefix = full.select(F.col("_vertex").alias("a"), F.substring("_full", 1, 8 * PREFIX).alias("prefix"))
            inside = inside.join(prefix, "a")
        more = _common.written(pair(_unjoined(inside, percent, best)).join(tested, ["a", "b"], "left_anti"), f"{where}/more-{k}")
        if more.isEmpty():
            continue
        tested = tested.unionByName(more)
        if best:
            full = _full_sets(docs, id_col, text_col, width, vertices, more, f"{where}/wanted-{k}")
        extra = _common.written(_confirmed(more, full, percent), f"{where}/links-{k}")
        if not extra.isEmpty():
            links = links.unionByName(extra)
            labels = components(links)

    labels = labels.join(vertices.select(F.col("_set").alias("vertex"), "_id"), "vertex")
    least = labels.groupBy("component").agg(F.min("_id").alias("_least"))
    roots = labels.join(least, "component").select(F.col("vertex").alias("_set"), "_least")
    # Written, so that both sides of the last join are shuffled for it and a set of many rows can be split.
    own = _common.written(vertices.join(roots, "_set", "left").select("_set", F.coalesce("_least", "_id").alias("_least")), f"{where}/own")
    at = F.coalesce("_least", "_id")
    return rows.select("_id", "_no_id", "_tag", "_size", "_set").join(own, "_set", "left").select(
        F.when(~F.col("_no_id"), F.col("_id")).alias(id_col),
        F.col("_size").cast("long").alias("n_shingles"),
        F.when(at != _common.NULL_ID, at).alias("component_id"),
        (F.col("_id") == at).alias("kept"),
        *([F.col("_tag")] if tag is not None else []),
    )


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
