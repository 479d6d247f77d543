"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, a scan of the training documents' token
windows, verification of the hits, and removal of spans or documents.

Words are runs of ASCII letters and digits and of characters that are not ASCII; A-Z count as a-z. A window is `n` consecutive
words of an item; an item of fewer words is one window. Every word of a document inside an occurrence of a window is hit.

Broadcasts are bounded. A benchmark of more than `slice_bytes` of text is reduced first: a bitmap of its windows' hashes, of at most
2 ** MAP_BITS bits, goes to one scan of the documents, which returns the distinct hashes that it may hold; only windows of those hashes make up the hash
set then. If even that is larger, it is cut into slices; each row passes them one after another in the same scan, on its whole text, and its
hits are merged in the row. So every row is judged by itself, whatever the benchmark's size.

Defined results: null and empty texts have no words; a null doc_id stays null; repeated rows are judged each by itself;
a null item_id counts as "null"; other columns of docs are kept by `clean` and ignored by `hits`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .bytehash import ALNUM, Words, chunks, utf8
from .common import Scratch, small_batches, table, text_bytes

N = 10
SLICE_BYTES = 4 << 20
#: Bits of the bitmap for each window, and of the whole bitmap as a power of 2 at most (64 MB).
BITS_EACH, MAP_BITS = 32, 29


class Windows:
    """The hash set of the windows of some benchmark items."""

    def __init__(self, items: list[tuple], n: int = N) -> None:
        found: dict[int, dict[int, dict[bytes, set]]] = {}
        w = Words(utf8(t for _, t in items), ALNUM)
        for i, (item, _) in enumerate(items):
            a, b = w.first[i], w.first[i + 1]
            if a == b:
                continue
            k = min(n, int(b - a))
            name = "null" if item is None else str(item)
            for at in range(a, b - k + 1):
                key = b" ".join(w.buf[w.start[j] : w.end[j]].tobytes() for j in range(at, at + k))
                found.setdefault(k, {}).setdefault(_one(w.hash[at : at + k]), {}).setdefault(key, set()).add(name)
        self.by_length = {k: (np.array(sorted(x), np.uint64), x) for k, x in found.items()}

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[int], set]]:
        """(words, [first, last + 1 of each hit run, ...] in words, items) of each text."""
        out: list[tuple[int, list[int], set]] = []
        for lo, hi in chunks(texts):
            w = Words(texts[lo:hi], ALNUM)
            hit = np.zeros(len(w.hash) + 1, np.int32)
            items: dict[int, set] = {}
            for k, (keys, known) in self.by_length.items():
                h = w.windows(k)
                at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h)
                text = np.searchsorted(w.first, at, "right") - 1
                ok = at + k <= w.first[text + 1]
                for j, i in zip(at[ok].tolist(), text[ok].tolist()):
                    same = known[int(h[j])].get(b" ".join(w.buf[w.start[x] : w.end[x]].tobytes() for x in range(j, j + k)))
                    if same:
                        hit[j] += 1
                        hit[j + k] -= 1
                        items.setdefault(i, set()).update(same)
            covered = np.cumsum(hit[:-1]) > 0
            for i in range(hi - lo):
                a, b = int(w.first[i]), int(w.first[i + 1])
                runs: list[int] = []
                if i in items:
                    edge = np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]]))
                    runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()
                out.append((b - a, runs, items.get(i, set())))
        return out


def _one(h: np.ndarray) -> int:
    from .bytehash import BASE, mix

    out = np.zeros(1, np.uint64)
    for x in h:
        out = out * BASE + x
    return int(mix(out)[0])


def _windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, text, k, h: the windows of the benchmark's items, as texts, with their numbers of words and hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, rows = Words(utf8(b["text"]), ALNUM), []
            for i, item in enumerate(b["item_id"]):
                x, y = int(w.first[i]), int(w.first[i + 1])
                k = min(n, y - x)
                for at in range(x, y - k + 1) if k else ():
                    rows.append(("null" if item is None else item, b" ".join(w.buf[w.start[j] : w.end[j]].tobytes() for j in range(at, at + k)).decode("utf-8", "surrogatepass"), k, _one(w.hash[at : at + k]) - (1 << 63)))
            yield pd.DataFrame(rows, columns=["item_id", "text", "k", "h"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(run, "item_id string, text string, k int, h bigint")


def _reduced(docs: DataFrame, benchmark: DataFrame, n: int, keep: Scratch) -> DataFrame:
    """item_id, text: the windows of the benchmark whose hashes are among those of docs."""
    spark = docs.sparkSession
    windows = keep.written(_windows(benchmark, n), "windows")
    count = windows.count()
    bits = min(MAP_BITS, max(16, int(count * BITS_EACH).bit_length()))
    # at most 2 ** (MAP_BITS - 6) words of 64 bits; h is the hash less 2 ** 63
    slot = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    words = windows.select(slot.alias("s")).selectExpr("cast(s >> 6 as int) AS at", "shiftleft(1L, cast(s & 63 as int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())
    shared = spark.sparkContext.broadcast((bits, bitmap.view(np.uint64), lengths))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, known, lengths = shared.value
        for b in batches:
            texts = utf8(b["text"])
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi], ALNUM)
                for k in lengths:
                    h = w.windows(k)
                    s = h >> np.uint64(64 - bits)
                    h = np.unique(h[known[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1) > 0])
                    yield pd.DataFrame({"k": np.full(len(h), k, np.int32), "h": (h ^ np.uint64(1 << 63)).view(np.int64)})

    found = docs.select("text").mapInPandas(run, "k int, h bigint").distinct()
    return keep.written(windows.join(found, ["k", "h"], "left_semi").select("item_id", "text").distinct(), "occurring")


def _slices(items: DataFrame, slice_bytes: int) -> Iterator[list[tuple]]:
    """The items in slices whose texts have at most about slice_bytes; one slice is at the driver at a time."""
    n = -(-text_bytes(items) // slice_bytes) or 1
    for i in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)).collect()]


def _merged(spans: list[int], more: list[int]) -> list[int]:
    """Two lists of runs as one, without overlaps."""
    if not spans or not more:
        return spans or more
    out: list[int] = []
    for a, b in sorted([*zip(spans[::2], spans[1::2]), *zip(more[::2], more[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, slice_bytes: int) -> tuple[DataFrame, tuple[str, str, str]]:
    """docs with three more columns, whose names are returned: n_words, hit_spans and items of the text."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    names = tuple(next(c for c in (f"{x}{'_' * i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns) for x in ("n_words", "hit_spans", "items"))
    keep = Scratch(spark, "decontamination")
    items = benchmark.select("item_id", "text")
    if text_bytes(items) > slice_bytes:
        items = _reduced(docs, items, n, keep)
    out = docs.withColumns({names[0]: F.lit(0).cast("bigint"), names[1]: F.array().cast("array<int>"), names[2]: F.array().cast("array<string>")})
    place = docs.columns.index("text")
    for part in _slices(items, slice_bytes):
        shared = spark.sparkContext.broadcast(part)

        def scan(batches, shared=shared):
            windows = Windows(shared.value, n)
            for b in batches:
                found = windows.scan(utf8(b.column(place).to_pylist()))
                last = b.num_columns - 3
                spans = [_merged(x, y[1]) for x, y in zip(b.column(last + 1).to_pylist(), found)]
                items = [sorted({*x, *y[2]}) for x, y in zip(b.column(last + 2).to_pylist(), found)]
                columns = [[y[0] for y in found], spans, items]
                yield pa.RecordBatch.from_arrays([*b.columns[:last], *(pa.array(c, b.schema.field(last + i).type) for i, c in enumerate(columns))], schema=b.schema)

        out = out.mapInArrow(scan, out.schema)
    keep.drop()
    return out, names


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, hit_spans (flat pairs of word positions, end exclusive), items."""
    out, _ = _scanned(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, n, slice_bytes)
    return out.drop("text")


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    h = hits(docs, benchmark, n, slice_bytes)
    n_hit = F.expr("cast(aggregate(hit_spans, 0, (s, x) -> x - s) as bigint)")
    return h.select(
        "doc_id", "n_words",
        # alternating sums: minus starts, plus ends
        n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words cut from text. Columns stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is {remove!r}; documents or spans")
    out, (words, spans, items) = _scanned(docs, benchmark, n, slice_bytes)
    if remove == "documents":
        return out.where(F.size(spans) == 0).drop(words, spans, items)
    place = docs.columns.index("text")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            texts = [_cut(t, x) for t, x in zip(b.column(place).to_pylist(), b.column(b.num_columns - 2).to_pylist())]
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    return out.mapInArrow(cut, out.schema).drop(words, spans, items)


def _cut(text: str | None, runs: list[int]) -> str | None:
    if not runs:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    w = Words([raw], ALNUM)
    at, out = 0, []
    for a, b in zip(runs[::2], runs[1::2]):
        out.append(raw[at : w.start[a]])
        at = int(w.end[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), {N}) AS k, unnest(list_transform(range(0, greatest(len(w) - {N}, 0) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), {N})], ' '))) AS s FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS i, w FROM d, ks WHERE len(w) >= k),
q AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s FROM p),
m AS (SELECT q.doc_id, q.k, q.i, g.item_id FROM q JOIN g ON q.k = g.k AND q.s = g.s),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
