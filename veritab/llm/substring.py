"""Exact substring deduplication: every byte that a long string covers which also starts in a document with a smaller id goes.

Where strings can match is found first, by sampled anchors: of each WINDOW bytes, the GRAM-byte string of the lowest hash is an anchor, so
equal windows have equal anchors at the same place. Only anchors that occur in two documents are looked at: their contexts, all the bytes
that a window around them can have, are suffixes which deep-shallow sorting puts in order. Multikey quicksort goes to the
shallow depth of the anchor itself; the groups that are still equal, those of long common prefixes, go into blind tries, one for
each place of the anchor in the window. Equal leaves are equal windows, and every occurrence but those of the smallest document is removed.

Scale: documents are dealt once into parts by a hash of the id, and three steps read that same exchange. Anchors travel as
packed arrays of 8 bytes each, contexts only for anchors that recur. Equal contexts within a part are settled there, all but those of the part's smallest
document, so a passage that a third of all documents share arrives once from each part. The contexts of very frequent anchors
are dealt by their whole windows, so a common line with different surroundings spreads. Exact copies leave beforehand.

Defined results: null and empty texts have no bytes; documents of fewer than WINDOW bytes lose nothing; a null doc_id is neither smaller nor
larger than another, so its row loses nothing and takes nothing; rows of equal doc_id take nothing from each other; repeats within a
document stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .bytehash import mix, utf8
from .common import parts_for, table, text_bytes

WINDOW, GRAM = 50, 24
#: Bytes that a window can have on either side of its anchor, and bytes of a context.
SIDE = WINDOW - GRAM
CONTEXT = GRAM + 2 * SIDE
#: Documents from which an anchor's windows are dealt one by one.
FREQUENT = 2000
PART_BYTES = 16 << 20
U = np.uint64
B = 0x9E3779B97F4A7C15
_POWERS = {k: U(pow(B, k, 1 << 64)) for k in (1, 2, 4, 8)}
#: A context with its valid bytes on either side, padded to whole 8-byte words, and whose it is.
RECORD = np.dtype([("bytes", np.uint8, (CONTEXT,)), ("left", np.uint8), ("right", np.uint8), ("pad", np.uint8, (2,)), ("doc", np.int64), ("row", np.uint32), ("at", np.uint32)])
RUN = np.dtype([("row", np.uint32), ("a", np.uint32), ("b", np.uint32)])
ALIAS = np.dtype([("record", np.uint32), ("at", np.uint32)])
WORDS_OF = (CONTEXT + 4) // 8


def grams(x: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings of x."""
    h = x.astype(U) + U(1)
    kept = {}
    for k in (1, 2, 4, 8):
        h = h[:-k] * _POWERS[k] + h[k:]
        kept[2 * k] = h
    n = len(x) - GRAM + 1
    return mix(kept[16][:n] * _POWERS[8] + kept[8][16 : 16 + n])


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) of each w neighbours."""
    k = 1
    while 2 * k <= w:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of x, which has WINDOW bytes at least."""
    g = grams(x)
    w = SIDE + 1
    low = _slide(g, w, np.minimum)
    edge = np.zeros(w - 1, U)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), w, np.maximum) >= g)
    return at, g[at]


def multikey(words: np.ndarray) -> np.ndarray:
    """Order of the rows of words (unsigned, most significant first) by three-way quicksort, one word at a depth."""
    n, depth = words.shape
    out, filled = np.empty(n, np.int64), 0
    stack = [(np.arange(n), 0)]
    while stack:
        rows, d = stack.pop()
        if len(rows) <= 512 or d == depth:
            if d < depth and len(rows) > 1:
                rows = rows[np.lexsort(tuple(words[rows, k] for k in range(depth - 1, d - 1, -1)))]
            out[filled : filled + len(rows)] = rows
            filled += len(rows)
            continue
        key = words[rows, d]
        pivot = np.sort(key[:: max(1, len(key) // 63)])[31 if len(key) >= 63 else len(key) // 2]
        less, more = key < pivot, key > pivot
        for part, below in ((rows[more], d), (rows[~less & ~more], d + 1), (rows[less], d)):
            if len(part):
                stack.append((part, below))
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of strings of equal length."""
    if a == b:
        return len(a)
    return len(a) - 1 - (((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() - 1) >> 3)


class BlindTrie:
    """Strings of one length by their branching places only. Each leaf is [string, least document]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, s: bytes, doc: int) -> list:
        """The leaf of s, with doc counted."""
        leaf = [s, doc]
        if self.root is None:
            self.root = leaf
            return leaf
        path, node = [], self.root
        while isinstance(node[0], int):  # a branch is [place, children]
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = node[0]
        if t == s:
            node[1] = min(node[1], doc)
            return node
        d = common_prefix(s, t)
        above = None
        for step in path:
            if step[0] > d:
                break
            above = step
        if above is not None and above[0] == d:
            above[1][s[d]] = leaf
            return leaf
        below = self.root if above is None else above[1][s[above[0]]]
        branch = [d, {t[d]: below, s[d]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][s[above[0]]] = branch
        return leaf

    def __iter__(self):
        """Leaves in order."""
        stack = [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[0], int):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node


def settle(r: np.ndarray) -> list[tuple[int, int, int]]:
    """(record, first, last + 1) of what smaller documents in r cover, around equal anchors."""
    key = r["bytes"][:, SIDE : SIDE + GRAM]
    words = np.ascontiguousarray(key).view(">u8").astype(U)
    order = multikey(words)
    same = (words[order[1:]] == words[order[:-1]]).all(1)
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(start, len(order)))
    whole = np.ascontiguousarray(r).view(np.uint8).reshape(len(r), RECORD.itemsize)[:, : CONTEXT + 2]
    doc, at = r["doc"], r["at"]
    out: list[tuple[int, int, int]] = []
    for a, n in zip(start[size > 1].tolist(), size[size > 1].tolist()):
        members = order[a : a + n].tolist()
        kinds: dict[bytes, list[int]] = {}
        for i in members:
            kinds.setdefault(whole[i].tobytes(), []).append(i)
        least = {k: min(int(doc[i]) for i in v) for k, v in kinds.items()}
        if len(kinds) == 1:
            (k, v), left, right = next(iter(kinds.items())), 0, 0
            left, right = k[CONTEXT], k[CONTEXT + 1]
            out += [(i, int(at[i]) - left, int(at[i]) + GRAM + right) for i in v if doc[i] > least[k]]
            continue
        first = min(least.values())
        if len(kinds) == 2:  # a trie of two leaves is a comparison
            x, y = kinds
            left = min(common_prefix(x[:SIDE][::-1], y[:SIDE][::-1]), x[CONTEXT], y[CONTEXT])
            right = min(common_prefix(x[SIDE + GRAM : CONTEXT], y[SIDE + GRAM : CONTEXT]), x[CONTEXT + 1], y[CONTEXT + 1])
            for k, other in ((x, y), (y, x)):
                own_left, own_right = k[CONTEXT], k[CONTEXT + 1]
                for i in kinds[k]:
                    if doc[i] > least[k]:
                        out.append((i, int(at[i]) - own_left, int(at[i]) + GRAM + own_right))
                    elif doc[i] > least[other] and left + right >= SIDE:
                        out.append((i, int(at[i]) - left, int(at[i]) + GRAM + right))
            continue
        tries = [BlindTrie() for _ in range(SIDE + 1)]
        leaves = {k: [(j, tries[j].add(k[SIDE - j : SIDE - j + WINDOW], least[k])) for j in range(max(0, SIDE - k[CONTEXT + 1]), min(SIDE, k[CONTEXT]) + 1)] for k in kinds}
        for k, v in kinds.items():
            for i in v:
                if doc[i] == first:
                    continue
                lo = hi = -1  # windows come from right to left: j bytes before the anchor
                for j, leaf in leaves[k]:
                    if leaf[1] < doc[i]:
                        x = int(at[i]) - j
                        if lo >= 0 and x <= hi and x + WINDOW >= lo:
                            lo = x
                        else:
                            if lo >= 0:
                                out.append((i, lo, hi))
                            lo, hi = x, x + WINDOW
                if lo >= 0:
                    out.append((i, lo, hi))
    return out


def _records(x: np.ndarray, at: np.ndarray, doc: int, row: int) -> np.ndarray:
    r = np.zeros(len(at), RECORD)
    wide = np.concatenate([np.zeros(SIDE, np.uint8), x, np.zeros(SIDE, np.uint8)])
    r["bytes"] = wide[at[:, None] + np.arange(CONTEXT)]
    r["left"], r["right"] = np.minimum(at, SIDE), np.minimum(len(x) - GRAM - at, SIDE)
    r["doc"], r["row"], r["at"] = doc, row, at
    return r


def _content(r: np.ndarray) -> np.ndarray:
    """A hash of each record's context."""
    words = np.ascontiguousarray(r).view(U).reshape(len(r), RECORD.itemsize // 8)[:, :WORDS_OF]
    h = np.zeros(len(r), U)
    for k in range(WORDS_OF):
        h = (h ^ words[:, k]) * U(B)
        h ^= h >> U(29)
    return mix(h)


def _combine(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records that are not settled among r, one for each context; aliases; runs that are settled)."""
    h = _content(r)
    order = np.lexsort((r["at"], r["row"], r["doc"], h))
    r, h = r[order], h[order]
    words = np.ascontiguousarray(r).view(U).reshape(len(r), RECORD.itemsize // 8)[:, :WORDS_OF]
    new = np.ones(len(r), bool)
    new[1:] = (h[1:] != h[:-1]) | (words[1:] != words[:-1]).any(1)
    group = np.cumsum(new) - 1
    least = r["doc"][new]
    done = r["doc"] > least[group]
    runs = np.zeros(int(done.sum()), RUN)
    d = r[done]
    runs["row"], runs["a"], runs["b"] = d["row"], d["at"] - d["left"], d["at"] + GRAM + d["right"]
    head_row = r["row"][new][group]
    again = ~new & ~done
    # repeats in the same row are aliases; rows of equal ids keep records of their own
    other = again & (r["row"] != head_row)
    keep = new | other
    place = np.cumsum(keep) - 1
    alias = np.zeros(int((again & ~other).sum()), ALIAS)
    alias["record"], alias["at"] = place[np.flatnonzero(new)[group[again & ~other]]], r["at"][again & ~other]
    return r[keep], alias, runs


def _windows(r: np.ndarray) -> np.ndarray:
    """A record for each single window of records r."""
    out = []
    for j in range(SIDE + 1):
        s = r[(r["left"] >= j) & (r["right"] >= SIDE - j)].copy()
        lo = SIDE - j
        s["bytes"][:, :lo] = 0
        s["bytes"][:, lo + WINDOW :] = 0
        s["left"], s["right"] = j, SIDE - j
        out.append(s)
    return np.concatenate(out)


def _rows(t: pd.DataFrame, copies: pd.DataFrame):
    """(row, doc_id or None, text as bytes, whether it copies a smaller document) in an order that does not depend on the shuffle."""
    t = t.assign(_null=t["doc_id"].isna()).sort_values(["_null", "doc_id"], kind="stable")
    if t["doc_id"].duplicated().any() or t["_null"].sum() > 1:
        t = t.assign(_t=t["text"].fillna("")).sort_values(["_null", "doc_id", "_t"], kind="stable")
    gone = dict()
    for i, digest in zip(copies["doc_id"], copies["digest"]):
        gone.setdefault(int(i), set()).add(digest)
    for k, (i, text) in enumerate(zip(t["doc_id"].tolist(), utf8(t["text"]))):
        i = None if pd.isna(i) else int(i)
        yield k, i, text, i in gone and hashlib.sha256(text).hexdigest() in gone[i]


MESSAGE = "part int, kind string, doc_id string, digest string, x binary, y binary"


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the runs (flat pairs of byte positions) of each row of docs."""
    spark = docs.sparkSession
    n_parts = parts_for(text_bytes(docs), PART_BYTES, spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # ids go as strings: pandas would make floats of a column with nulls
    t = source.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("int").alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    digests = source.where("doc_id is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("n")).where(F.col("n") >= WINDOW)
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copies = digests.join(first, "digest").where("doc_id > first").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("int").alias("part"), F.lit("copy").alias("kind"), F.col("doc_id").cast("string").alias("doc_id"), "digest", F.lit(None).cast("binary").alias("x"), F.lit(None).cast("binary").alias("y")
    )

    def integer(t: pd.DataFrame) -> pd.DataFrame:
        return t.assign(doc_id=pd.array([None if x is None else int(x) for x in t["doc_id"]], "Int64"))

    def message(part, kind, x, y=None) -> pd.DataFrame:
        return pd.DataFrame({"part": np.asarray(part, np.int32), "kind": kind, "doc_id": None, "digest": None, "x": x, "y": [None] * len(x) if y is None else y})

    none = pd.DataFrame({"part": np.zeros(0, np.int32), "kind": [], "doc_id": [], "digest": [], "x": [], "y": []})

    def split(bucket: np.ndarray):
        """(bucket, first, last + 1) of the runs of a sorted array."""
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        return zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(bucket)])

    def sample(key, t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """The distinct anchors of a part, with the number of its documents that have them, up to 255. part is the bucket here."""
        found = [np.unique(anchors(np.frombuffer(text, np.uint8))[1]) for _, i, text, copy in _rows(integer(t), integer(c)) if i is not None and not copy and len(text) >= WINDOW]
        if not found:
            return none
        h, n = np.unique(np.concatenate(found), return_counts=True)
        bucket = (h % U(n_parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, n = h[order], np.minimum(n[order], 255).astype(np.uint8)
        runs = list(split(bucket[order]))
        out = message([b for b, _, _ in runs], "anchors", [h[x:y].tobytes() for _, x, y in runs], [n[x:y].tobytes() for _, x, y in runs])
        out["doc_id"] = str(key[0] if len(t) or not len(c) else key[0])
        return out

    def recur(key, m: pd.DataFrame) -> pd.DataFrame:
        """To each part, its anchors of this bucket that two documents have, and whether they are very frequent."""
        h = np.concatenate([np.frombuffer(x, U) for x in m["x"]])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in m["y"]]).astype(np.int64)
        part = np.repeat(m["doc_id"].astype(int).to_numpy(), [len(x) // 8 for x in m["x"]])
        order = np.argsort(h, kind="stable")
        h, n, part = h[order], n[order], part[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        total = np.bincount(np.cumsum(new) - 1, n)[np.cumsum(new) - 1]
        keep = total > 1
        h, part, often = h[keep], part[keep], (total[keep] >= FREQUENT).astype(np.uint8)
        order = np.argsort(part, kind="stable")
        h, part, often = h[order], part[order], often[order]
        runs = list(split(part))
        return message([p for p, _, _ in runs], "recur", [h[x:y].tobytes() for _, x, y in runs], [often[x:y].tobytes() for _, x, y in runs])

    def contexts(key, t: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        """The contexts of a part's recurring anchors to their buckets; what is settled here goes along. part is the bucket here."""
        r = m[m["kind"] == "recur"]
        if not len(r):
            return none
        known = np.concatenate([np.frombuffer(x, U) for x in r["x"]])
        often = np.concatenate([np.frombuffer(x, np.uint8) for x in r["y"]])
        order = np.argsort(known)
        known, often = known[order], often[order]
        got, frequent, buckets = [], [], []
        for k, i, text, copy in _rows(integer(t), integer(m[m["kind"] == "copy"])):
            if i is None or copy or len(text) < WINDOW:
                continue
            x = np.frombuffer(text, np.uint8)
            at, h = anchors(x)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ok = known[place] == h
            got.append(_records(x, at[ok], i, k))
            frequent.append(often[place[ok]] > 0)
        if not got:
            return none
        rec, frequent = np.concatenate(got), np.concatenate(frequent)
        out = []
        for r, single in ((rec[~frequent], False), (rec[frequent], True)):
            if not len(r):
                continue
            r, alias, runs = _combine(r)
            if single:
                # aliases and windows don't go together: repeats become records again
                more = r[alias["record"]].copy()
                more["at"] = alias["at"]
                r, alias, more_runs = _combine(_windows(np.concatenate([r, more])))
                runs = np.concatenate([runs, more_runs])
                bucket = (_content(r) % U(n_parts)).astype(np.int64)
            else:
                x = np.ascontiguousarray(r["bytes"][:, SIDE : SIDE + GRAM]).view(U)
                h = np.zeros(len(r), U)
                for k in range(x.shape[1]):
                    h = mix((h ^ x[:, k]) * U(B))
                bucket = (h % U(n_parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            spot = np.empty(len(order), np.int64)
            spot[order] = np.arange(len(order))
            r, bucket = r[order], bucket[order]
            alias["record"] = spot[alias["record"]]
            alias = alias[np.argsort(alias["record"], kind="stable")]
            spans = list(split(bucket))
            first = np.searchsorted(alias["record"], [x for _, x, _ in spans])
            last = np.searchsorted(alias["record"], [y for _, _, y in spans])
            ys = []
            for (_, x, _), a, b in zip(spans, first, last):
                own = alias[a:b].copy()
                own["record"] -= x
                ys.append(own.tobytes())
            o = message([b for b, _, _ in spans], "contexts", [r[x:y].tobytes() for _, x, y in spans], ys)
            out.append(o)
            if len(runs):
                out.append(message([key[0]], "runs", [runs.tobytes()]))
        out = pd.concat(out)
        out["doc_id"] = str(int(key[0]))
        return out

    def decide(key, m: pd.DataFrame) -> pd.DataFrame:
        """The runs that smaller documents cover, to their parts."""
        c = m[m["kind"] == "contexts"]
        out = [message(m[m["kind"] == "runs"]["doc_id"].astype(int), "runs", list(m[m["kind"] == "runs"]["x"]))]
        if len(c):
            rec = [np.frombuffer(x, RECORD) for x in c["x"]]
            part = np.repeat(c["doc_id"].astype(int).to_numpy(), [len(x) for x in rec])
            shift = np.cumsum([0, *[len(x) for x in rec]])
            alias = {}
            for y, s in zip(c["y"], shift):
                for i, at in np.frombuffer(y, ALIAS).tolist():
                    alias.setdefault(i + int(s), []).append(at)
            rec = np.concatenate(rec)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for i, a, b in settle(rec):
                at, row = int(rec["at"][i]), int(rec["row"][i])
                own = found.setdefault(int(part[i]), [])
                own.append((row, a, b))
                own += [(row, a - at + x, b - at + x) for x in alias.get(i, ())]
            if found:
                out.append(message(list(found), "runs", [np.array(v, RUN).tobytes() for v in found.values()]))
        return pd.concat(out)

    def finish(key, t: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(x, RUN) for x in m[m["kind"] == "runs"]["x"]]
        runs = np.sort(np.concatenate(runs), order=["row", "a"]) if runs else np.zeros(0, RUN)
        rows = []
        for k, i, text, copy in _rows(integer(t), integer(m[m["kind"] == "copy"])):
            lo, hi = np.searchsorted(runs["row"], [k, k + 1])
            cut: list[int] = [0, len(text)] if copy else []
            if not copy and lo < hi:
                a, b = runs["a"][lo:hi].astype(np.int64), np.maximum.accumulate(runs["b"][lo:hi].astype(np.int64))
                new = np.concatenate([[True], a[1:] > b[:-1]])
                ends = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
                cut = np.stack([a[new], b[ends]], 1).ravel().tolist()
            kept = b"".join([text[x:y] for x, y in zip([0, *cut[1::2]], [*cut[::2], len(text)])]) if cut else text
            rows.append((None if i is None else str(i), len(text), len(text) - len(kept), len(cut) // 2, hashlib.sha256(kept).hexdigest(), cut))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])

    of = lambda df: df.groupBy("part")
    found = of(t).cogroup(of(copies)).applyInPandas(sample, MESSAGE)
    again = of(found).applyInPandas(recur, MESSAGE)
    sent = of(t).cogroup(of(again.unionByName(copies))).applyInPandas(contexts, MESSAGE)
    runs = of(sent).applyInPandas(decide, MESSAGE)
    out = of(t).cogroup(of(runs.unionByName(copies))).applyInPandas(finish, "doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, runs array<bigint>")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("runs")


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
p AS (SELECT doc_id, h, unnest(range(0, greatest(n - {WINDOW} + 1, 0))) AS i FROM n),
w AS MATERIALIZED (SELECT doc_id, i, hash(substr(h, 2 * i + 1, {2 * WINDOW})) AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
m AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s WHERE f.first < w.doc_id),
b AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
r AS (SELECT doc_id, run, min(i) AS x, max(i) + {WINDOW} AS y FROM g GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY doc_id ORDER BY x), 0) AS kept_from FROM r),
k AS (SELECT q.doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (x - kept_from)), '' ORDER BY x) AS head, max(y) AS last, sum(y - x) AS removed, count(*) AS spans FROM q JOIN n ON q.doc_id = n.doc_id GROUP BY q.doc_id)
SELECT n.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN k ON n.doc_id = k.doc_id
"""
