"""Secret scan with multipart credential linking.

Base patterns (assigned secrets, access identifiers, long hexadecimal runs) count on their own. Weak
candidates (account identifiers, bare keys, endpoints) are reported only when complementary parts lie within
their scope: the candidate's interval, widened by SCOPE code points either way, or its block, is joined with
the intervals of the other parts by a binary search over their sorted starts. A block is the innermost pair of
braces around the candidate, with all it holds, or else what blank lines and the text's ends bound. An
identifier needs a secret, a bare key needs an identifier, an endpoint needs both. Weak candidates inside a
base match add nothing, and an identifier's own value is not its key.

Each row is scanned on its own, without a shuffle; only the text goes through Python. Null text has no spans
and stays null; null or repeated identifiers are kept, a row for each row; an empty table gives no rows;
columns of any name are left alone.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import _common

SCOPE = 300
#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak candidates.
ACCOUNT = re.compile(r"""(?:client|account|tenant|access_?key|user)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", re.ASCII | re.IGNORECASE)
BARE_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
BARE_HINT = re.compile(r"[A-Za-z0-9+/]{32}")
ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", re.ASCII)
BRACE = re.compile(r"[{}]")
BLANK = re.compile(r"\n[^\S\n]*(?=\n)")
KINDS = ("assign", "access", "hex", "account", "key", "endpoint")

Span = tuple[int, int, int]  # start, end, position in KINDS


def base_spans(text: str) -> list[Span]:
    """Runs of 24 or more hexadecimal digits are whole runs, so LONG_HEX finds what HEX and a filter do."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


class Intervals:
    """Spans sorted by start, with the running maximum of ends, for overlap tests."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s[0] for s in spans]
        self.ends: list[int] = []
        for s in spans:
            self.ends.append(max(s[1], self.ends[-1] if self.ends else 0))

    def meets(self, start: int, end: int) -> bool:
        """Whether any span overlaps [start, end)."""
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def blocks(text: str, parts: list[Span]) -> dict[int, tuple[int, int]]:
    """The block of each part by its start."""
    closes, opened = {}, []
    braces = [m.start() for m in BRACE.finditer(text)]
    for at in braces:
        if text[at] == "{":
            opened.append(at)
        elif opened:
            closes[opened.pop()] = at
    pairs = sorted(closes.items())
    blanks = [0, *(m.start() for m in BLANK.finditer(text)), len(text)]
    out, around, k = {}, [], 0
    for start in sorted({s[0] for s in parts}):
        while k < len(pairs) and pairs[k][0] < start:
            while around and around[-1][1] < pairs[k][0]:
                around.pop()
            around.append(pairs[k])
            k += 1
        while around and around[-1][1] < start:
            around.pop()
        n = min(bisect.bisect_right(blanks, start), len(blanks) - 1)
        out[start] = around[-1] if around else (blanks[n - 1], blanks[n])
    return out


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates whose complementary parts are in scope."""
    taken = Intervals(base)
    find = lambda pattern, kind: [(m.start(), m.end(), kind) for m in pattern.finditer(text) if not taken.meets(m.start(), m.end())]
    accounts = find(ACCOUNT, 3) if "=" in text or ":" in text else []
    keys = find(BARE_KEY, 4) if BARE_HINT.search(text) else []
    if accounts and keys:
        keys = [k for k in keys if not any(a[0] <= k[0] and k[1] <= a[1] for a in accounts[max(0, bisect.bisect(accounts, k) - 1) :][:1])]
    if not base and not (accounts and keys):
        return []
    endpoints = find(ENDPOINT, 5) if "://" in text else []
    identifiers = Intervals([s for s in base if s[2] == 1] + accounts)
    secrets = Intervals([s for s in base if s[2] != 1] + keys)
    block = blocks(text, accounts + keys + endpoints)
    near = lambda s, parts: parts.meets(s[0] - SCOPE, s[1] + SCOPE) or parts.meets(*block[s[0]])
    out = [s for s in accounts if near(s, secrets)] + [s for s in keys if near(s, identifiers)]
    return out + [s for s in endpoints if near(s, identifiers) and near(s, secrets)]


def spans(text: str | None) -> list[Span]:
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base), key=lambda s: (s[0], s[2]))


def redacted(text: str, found: list[Span], by: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, end, _ in sorted(found):
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join(out) + text[at:]


_FOUND = StructType(
    [
        StructField("spans", ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))),
        StructField("redacted", StringType()),
    ]
)


def secrets(text: Column) -> Column:
    """Struct of spans (array of kind, start, end in code points, end exclusive) and redacted (the text without
    them; null where it has none)."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _common.worker_memory("secret_scan")
        for batch in batches:
            told, clean = [], []
            for _, texts in _common.text_parts(pa.RecordBatch.from_arrays([batch], ["text"]), 0):
                for x in texts:
                    found = spans(x)
                    told.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in found])
                    clean.append(redacted(x, found) if found else None)
            yield pa.StructArray.from_arrays([pa.array(told, pa.list_(kind)), pa.array(clean, pa.string())], ["spans", "redacted"])
        _common.trim()

    return run(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """identifier, spans (array of kind, start, end in code points, end exclusive), redacted text."""
    _common.shipped(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = own.withColumn("found", secrets(F.col("text")))
    return out.select(F.col("id").alias(id_col), F.col("found.spans").alias("spans"), F.coalesce("found.redacted", "text").alias("redacted"))


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, secrets in the texts replaced; all other columns are as they were."""
    _common.shipped(docs.sparkSession)
    name = _common.free_name(docs, "_found")
    return docs.withColumn(name, secrets(F.col(text_col))).withColumn(text_col, F.coalesce(F.col(name)["redacted"], F.col(text_col))).drop(name)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
    )
