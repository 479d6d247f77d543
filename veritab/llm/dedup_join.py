"""Exact Jaccard join on word shingles by parity sketches.

Let two sets of a and b shingles have a Jaccard similarity of 3/4 or more. Their symmetric difference is then at most
(a + b) / 7, and neither has more than 4/3 of the other's size. Each set's hashes are XORed into blocks; the sizes of an octave,
a band, have the same number of blocks. An element of the symmetric difference changes one block, so the number of blocks that
differ is a lower bound of the symmetric difference, and by the pigeonhole principle the lowest floor((a + max b) / 7) + 1 of a set's
non-empty blocks, in one order for all sets, hold a block that a similar set has among its own. So the join is on (band, block,
XOR). Candidates must pass a parity bit sketch, whose Hamming distance is another lower bound, and are then verified on
their whole texts.

Small sets have a block for each shingle. A set with no more non-empty blocks than the bound (a matter of chance far below one in
a million) is weak: then all sets of like sizes use blocks of one shingle as well, so nothing is lost.

Copies and skew: sets are joined once for each different set, under an id that is a hash of the set. A block that few sets share
gives all its pairs. One that many share, or that consists of very frequent shingles, gives a star and is kept: after the stars are
verified and joined to components, further stars join what is left to the largest component, and in the end only pairs of different
components are compared in full. Groups of copies therefore never meet as all pairs. Very frequent shingles come last in the order of blocks, and blocks of nothing else are salted.

Defined results: a null text, and one without words, has an empty set and is linked with nothing; a document of fewer than
5 words has one shingle; repeated rows are copies; a null doc_id is null again but can't name a component. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .bytehash import SPACED, Words, chunks, mix, utf8
from .common import Scratch, parts_for, small_batches, table, written

WORDS = 5
#: Sets of fewer shingles have a block for each.
SMALL = 64
#: Blocks that more sets share than this give stars first; others give at most 28 pairs.
ALL_PAIRS = 8
#: Ends of pairs that are broadcast to the texts, at most: 32 bytes each.
BROADCAST_PAIRS = 500_000
#: Ids that are broadcast, with a label or not, at most: 16 bytes each.
BROADCAST_IDS = 1_000_000
#: A shingle is very frequent from that share of the documents on. Over all documents there are at most 1 / HOT_SHARE times the mean number of shingles.
HOT_SHARE, HOT_LEAST = 5e-4, 30
#: Shingles that are counted at a time.
COUNTED = 2_000_000
#: Signatures of a bucket, about. By its 32 bits there, one in some two thousand meets another by chance: a candidate more.
BUCKET_SIGNATURES = 2_000_000
#: Size classes that similar sets can be apart, and texts that are compared with a hub in one task.
NEAR_CLASSES, HUB_TEXTS = 5, 64
#: Rounds of stars around other members before what is left is compared as sketches, and sets of a side of a family then.
STAR_ROUNDS, SIDE = 1, 400
U = np.uint64


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi], SPACED)
        g = w.windows(words)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(g[a : b - words + 1]))
            elif b > a:
                h = U(b - a)
                for x in w.hash[a:b]:
                    h = mix(np.array([h], U) * U(0xD6E8FEB86659FD93) + x)[0]
                out.append(np.array([h], U))
            else:
                out.append(np.zeros(0, U))
    return out


def most_differences(a: int) -> int:
    return (a + 4 * a // 3) // 7


def bands(a: int) -> list[int]:
    """Numbers of blocks of the bands that a set of a shingles is joined in: its own and, if smaller partners are there, the one below."""
    own = 0 if a < SMALL else 1 << (a.bit_length() - 1)
    least = -(-3 * a // 4)
    below = 0 if least < SMALL else 1 << (least.bit_length() - 1)
    return [own] if own == below else [own, below]


def signatures(s: np.ndarray, blocks: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, whether of very frequent shingles only) of the non-empty blocks."""
    seen = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
    if not blocks:
        return mix(s ^ U(0xA5A5A5A5A5A5A5A5)), seen
    block = (s >> U(65 - blocks.bit_length())).astype(np.int64)  # s is sorted, so blocks are runs
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    lanes = np.bitwise_xor.reduceat(mix(s + U(0x632BE59BD9B4E019)), start)
    sig = mix(lanes ^ mix(block[start].astype(U) * U(0x9FB21C651E98DF25) + U(blocks)))
    return sig, np.logical_and.reduceat(seen, start)


def prefix(s: np.ndarray, blocks: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that a set is joined by, in the order of all sets: very frequent ones last, then by hash."""
    sig, frequent = signatures(s, blocks, hot)
    n = most_differences(len(s)) + 1
    if len(sig) > n:
        keep = np.lexsort((sig, frequent))[:n]
        sig, frequent = sig[keep], frequent[keep]
    return sig, frequent


def weak(s: np.ndarray) -> bool:
    none = np.zeros(0, U)
    return any(len(signatures(s, b, none)[0]) <= most_differences(len(s)) for b in bands(len(s)))


def bits(s: np.ndarray) -> bytes:
    """A parity bit sketch of four to eight bits for each shingle. Sketches of half the bits are its halves' XOR."""
    m = max(64, 1 << len(s).bit_length() + 2)
    return np.packbits(np.bincount(((s * U(0xC2B2AE3D27D4EB4F)) >> U(40)).astype(np.int64) % m, minlength=m) % 2 == 1).tobytes()


def thin(sketch: bytes) -> bytes:
    """The sketch folded to a quarter of its bits, 64 at least: enough to tell most pairs apart."""
    x = np.frombuffer(sketch, U)
    return np.bitwise_xor.reduce(x.reshape(-1, max(1, len(x) // 4)), 0).tobytes()


def hamming(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, U), np.frombuffer(y, U)
    width = min(len(a), len(b))
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, width), 0) ^ np.bitwise_xor.reduce(b.reshape(-1, width), 0)).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both) and both > 0


def size_class(n: int) -> int:
    """Twelfths of an octave. Sizes within 4/3 of each other are at most NEAR_CLASSES classes apart; sizes from 2 ** 21.25 on are one class."""
    return min(255, int(12 * math.log2(n) + 1e-9)) if n else 0


def _set_id(s: np.ndarray) -> int:
    """56 bits of a hash of the set, then its size class: whoever sees two ids can tell sizes that do not match."""
    return (int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=7).digest(), "little", signed=True) << 8) | size_class(len(s))


def _sizes_match(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.abs((u & 255) - (v & 255)) <= NEAR_CLASSES


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, set_id, bits, thin, weak of each row of docs; and rows of h, k: shingles that are frequent among many documents of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held, n_docs = [], 0, 0

        def frequent() -> tuple[np.ndarray, np.ndarray]:
            h, k = np.unique(np.concatenate(held), return_counts=True)
            often = k >= max(3, HOT_SHARE / 2 * n_docs)
            return h[often].view(np.int64), k[often]

        def frame(rows: list[tuple], h=(), k=()) -> pd.DataFrame:
            # masked integers throughout: floats would not hold 64 bits
            m, whole = len(h), lambda x: pd.array(x, "Int64")
            ids, n, sets_, sketches, flags = zip(*rows) if rows else [()] * 5
            none = [None] * m
            return pd.DataFrame({"doc_id": whole([*ids, *none]), "n": whole([*n, *none]), "set_id": whole([*sets_, *none]), "bits": [*sketches, *none], "thin": [*map(thin, sketches), *none], "weak": pd.array([*flags, *none], "boolean"), "h": whole([None] * len(rows) + [int(x) for x in h]), "k": whole([None] * len(rows) + [int(x) for x in k])})

        for b in batches:
            got = shingles(utf8(b["text"]), words)
            yield frame([(None if i is None else int(i), len(x), _set_id(x), bits(x), len(x) > 0 and weak(x)) for i, x in zip(b["doc_id"], got)])
            held += got
            n_held, n_docs = n_held + sum(map(len, got)), n_docs + len(got)
            if n_held >= COUNTED:
                yield frame([], *frequent())
                held, n_held, n_docs = [], 0, 0
        if n_held:
            yield frame([], *frequent())

    return docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, n bigint, set_id bigint, bits binary, thin binary, weak boolean, h bigint, k bigint")


def places(sizes: list[tuple[int, int]], weak_sizes: tuple[int, int] | None, wanted: int) -> tuple[dict[int, tuple[int, int]], int]:
    """({band: its first bucket and how many it has}, number of buckets), of about `wanted` buckets by the bands' numbers of signatures.

    Signatures of different bands never meet, so the id of a set has to go to the buckets of its own bands only. sizes: (the greatest size of a
    size class, shingles of all its sets).
    """
    volume = dict.fromkeys([0, *(1 << k for k in range(SMALL.bit_length() - 1, max([n for n, _ in sizes], default=0).bit_length()))], 0)
    for n, all_ in sizes:
        for blocks in {*bands(n), *([0] if weak_sizes else [])}:
            volume[blocks] += all_ // 3 + 1
    total = max(1, sum(volume.values()))
    out, first = {}, 0
    for blocks, k in volume.items():
        out[blocks] = first, max(1, round(wanted * k / total))
        first += out[blocks][1]
    return out, first


def _blobs(docs: DataFrame, place: dict[int, tuple[int, int]], n_buckets: int, hot, weak_sizes: tuple[int, int] | None, words: int) -> DataFrame:
    """bucket, sigs, ids, runs: packed signatures by set, the ids of the sets and how many signatures each has (255 at most; the id is there again for more).

    bucket is at or over n_buckets for salted ones, whose signatures are whole; others are cut to the upper half.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = hot.value
        for b in batches:
            sig, ids, often, bucket = [], [], [], []
            done = set()
            for s in shingles(utf8(b["text"]), words):
                if not len(s) or (i := _set_id(s)) in done:
                    continue
                done.add(i)
                use = bands(len(s))
                if weak_sizes and 0 not in use and weak_sizes[0] * 3 // 4 <= len(s) <= weak_sizes[1] * 4 // 3 + 1:
                    use.append(0)
                for blocks in use:
                    x, f = prefix(s, blocks, known)
                    sig.append(x)
                    often.append(f)
                    ids.append(np.full(len(x), i, np.int64))
                    bucket.append(place[blocks][0] + (x % U(place[blocks][1])).astype(np.int64))
            if not sig:
                continue
            sig, ids, often, bucket = np.concatenate(sig), np.concatenate(ids), np.concatenate(often), np.concatenate(bucket)
            bucket[often] = n_buckets + (bucket[often] + ids[often]) % n_buckets
            order = np.argsort(bucket, kind="stable")  # within a bucket by set
            sig, ids, bucket = sig[order], ids[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = []
            for x, y in zip(cut, [*cut[1:], len(bucket)]):
                own = ids[x:y]
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                run_of, runs = _runs(np.diff(np.append(new, y - x)))
                out.append(((sig[x:y] if bucket[x] >= n_buckets else (sig[x:y] >> U(32)).astype(np.uint32)).tobytes(), own[new][run_of].tobytes(), runs.tobytes()))
            yield pd.DataFrame({"bucket": bucket[cut], **{c: list(v) for c, v in zip(("sigs", "ids", "runs"), zip(*out))}})

    return docs.select("text").mapInPandas(run, "bucket bigint, sigs binary, ids binary, runs binary")


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, length) of runs that are cut to lengths of one byte."""
    cuts = -(-lengths // 255)
    out = np.full(cuts.sum(), 255, np.uint8)
    out[np.cumsum(cuts) - 1] = lengths - 255 * (cuts - 1)
    return np.repeat(np.arange(len(lengths)), cuts), out


def _candidates(blobs: DataFrame, n_buckets: int) -> DataFrame:
    """u, v: pairs of set ids whose sizes match. Rows with sig: u is a member of a block that gave a star, whose hub is v."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        salted = key[0] >= n_buckets
        sig = np.concatenate([np.frombuffer(x, U if salted else np.uint32) for x in rows["sigs"]])
        ids = np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]]), np.concatenate([np.frombuffer(x, np.uint8) for x in rows["runs"]]))
        order = np.argsort(sig, kind="stable")
        sig, ids = sig[order], ids[order]
        cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(cut, len(sig)))
        u, v, stars = [], [], []
        two = cut[size == 2] if not salted else cut[:0]
        u.append(ids[two])
        v.append(ids[two + 1])
        several = (size > 2) | salted
        for a, n in zip(cut[several].tolist(), size[several].tolist()):
            m = np.unique(ids[a : a + n])
            if len(m) <= ALL_PAIRS and not salted:
                x, y = np.triu_indices(len(m), 1)
                u.append(m[x])
                v.append(m[y])
            else:
                stars.append((sig[a] if salted else U(key[0]) << U(32) | U(sig[a]), m))
                u.append(np.full(len(m) - 1, m[0]))
                v.append(m[1:])
        u, v = np.concatenate(u), np.concatenate(v)
        fits = (u != v) & _sizes_match(u, v)
        low, high = np.minimum(u, v)[fits], np.maximum(u, v)[fits]
        pairs = np.unique(np.stack([low, high], 1), axis=0)
        out = [pd.DataFrame({"sig": pd.array([None] * len(pairs), "Int64"), "u": pairs[:, 0], "v": pairs[:, 1]})]
        if stars:
            out.append(pd.DataFrame({"sig": pd.array(np.repeat(np.array([s for s, _ in stars], U).view(np.int64), [len(m) for _, m in stars]), "Int64"), "u": np.concatenate([m for _, m in stars]), "v": np.concatenate([np.full(len(m), m[0]) for _, m in stars])}))
        return pd.concat(out)

    return blobs.groupBy("bucket").applyInPandas(run, "sig bigint, u bigint, v bigint")


def _few(df: DataFrame, most: int) -> DataFrame:
    """df (written), to be broadcast if it has at most that many rows."""
    return F.broadcast(df) if df.count() <= most else df


def _verified(pairs: DataFrame, kinds: DataFrame, docs: DataFrame, words: int, keep: Scratch) -> DataFrame:
    """The pairs u, v that are similar. kinds: set_id, n, thin, first (a document that has the set).

    Pairs that pass the thin sketches are compared on their texts, by hub: in a task, the text of v once and those of up to
    HUB_TEXTS partners.
    """
    side = lambda p: kinds.select(F.col("set_id").alias(p), F.col("n").alias(f"n{p}"), F.col("thin").alias(f"bits{p}"), F.col("first").alias(f"first{p}"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [4 * n >= 3 * m and 4 * m >= 3 * n and hamming(x, y) <= (n + m) // 7 for x, y, n, m in zip(b["bitsu"], b["bitsv"], b["nu"], b["nv"])]
            yield b.loc[ok, ["u", "v", "firstu", "firstv"]]

    maybe = keep.written(pairs.join(side("v"), "v").join(side("u"), "u").mapInPandas(close, "u bigint, v bigint, firstu bigint, firstv bigint"), "sketch-pairs")
    degree = maybe.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / HUB_TEXTS).alias("parts"))
    ends = maybe.join(degree, "v").withColumn("part", F.pmod(F.xxhash64("u"), "parts"))
    ends = ends.select("v", "part", F.explode(F.array(F.struct(F.col("firstu").alias("doc_id"), F.col("u").alias("set_id")), F.struct(F.col("firstv").alias("doc_id"), F.col("v").alias("set_id")))).alias("e")).select("v", "part", "e.*").distinct()
    ends = keep.written(ends, "ends")

    def same(key, rows: pd.DataFrame) -> pd.DataFrame:
        # rows that share a doc_id can bring another text than the set's
        found = {}
        for s in shingles(utf8(dict.fromkeys(rows["text"])), words):
            found.setdefault(_set_id(s), s)
        hub = found.get(key[0])
        ok = [] if hub is None else [u for u in rows["set_id"].unique() if u != key[0] and u in found and similar(found[u], hub)]
        return pd.DataFrame({"u": np.array(ok, np.int64), "v": np.full(len(ok), key[0], np.int64)})

    both = docs.select("doc_id", "text").join(_few(ends, BROADCAST_PAIRS), "doc_id").select("v", "part", "set_id", "text")
    return keep.written(both.groupBy("v", "part").applyInPandas(same, "u bigint, v bigint"), "links")


def components(edges: DataFrame, keep: Scratch) -> DataFrame | None:
    """node, label of the connected components of edges u, v by contraction; None without edges.

    Each round, every node goes to the least of itself and its neighbours, and edges are renamed. Ids are hashes, so the
    nodes that stay are a random share, and the rounds are logarithmic in number.
    """
    maps = []
    e = keep.written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    while not e.isEmpty():
        m = keep.written(e.union(e.select("v", "u")).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to")), "contract")
        maps.append(m)
        x, y = m.select(F.col("node").alias("u"), F.col("to").alias("u2")), m.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        e = e.join(x, "u").join(y, "v").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).where("u <> v").distinct()
        e = keep.written(e, "edges")
    if not maps:
        return None
    out = maps[0].select("node", F.col("to").alias("label"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return keep.written(out, "components")


def _joined(labels: DataFrame | None, links: DataFrame, keep: Scratch) -> DataFrame | None:
    """labels after more links: only the links between components are contracted."""
    if labels is None:
        return components(links, keep)
    of = lambda p: labels.select(F.col("node").alias(p), F.col("label").alias(f"l{p}"))
    e = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    more = components(e, keep)
    if more is None:
        return labels
    to = more.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = more.join(labels.select("node"), "node", "left_anti")
    return keep.written(old.unionByName(new), "components")


def _split(stars: DataFrame, labels: DataFrame | None, keep: Scratch) -> DataFrame:
    """sig, u, label of the blocks that several components are in."""
    s = stars.select("sig", "u", F.col("u").alias("label"))
    if labels is not None:
        s = stars.join(_few(labels.withColumnRenamed("node", "u"), BROADCAST_IDS), "u", "left").select("sig", "u", F.coalesce("label", "u").alias("label"))
    several = s.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("sig")
    return keep.written(s.join(_few(keep.written(several, "several"), BROADCAST_IDS), "sig", "left_semi"), "split")


def _more_stars(split: DataFrame, seed: int) -> DataFrame:
    """u, v: in each block, the members of other components with a random member v of the component that most of the block is in."""
    sizes = split.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64("u", F.lit(seed)), "u")).alias("r"))
    hub = sizes.groupBy("sig").agg(F.max(F.struct("k", "label", F.col("r.u").alias("v"))).alias("h")).select("sig", F.col("h.label").alias("own"), F.col("h.v").alias("v"))
    return split.join(hub, "sig").where((F.col("label") != F.col("own")) & _classes_match("u", "v")).select("u", "v").distinct()


def _classes_match(u: str, v: str) -> Column:
    return F.abs(F.col(u).bitwiseAND(255) - F.col(v).bitwiseAND(255)) <= NEAR_CLASSES


def _rest(split: DataFrame, seen: DataFrame, keep: Scratch) -> DataFrame:
    """Pairs of different components from blocks that several are still in, after size and sketch.

    Blocks with the same member of most blocks have much the same members, a family: they are taken together, so that a pair is compared
    once rather than for each block. A family of over SIDE sets is cut into sides, and each two sides meet in a task of their own. Only
    pairs that pass leave the comparison.
    """
    involved = keep.written(split.groupBy(F.col("u").alias("set_id")).agg(F.count(F.lit(1)).alias("blocks")), "involved")
    hubs = split.join(_few(involved.withColumnRenamed("set_id", "u"), BROADCAST_IDS), "u").groupBy("sig").agg(F.max(F.struct("blocks", "u")).alias("h")).select("sig", F.col("h.u").alias("hub"))
    family = keep.written(split.join(_few(keep.written(hubs, "hubs"), BROADCAST_IDS), "sig").select("hub", "u", "label").distinct(), "family")
    bits_of = seen.where("n > 0").join(_few(involved.select("set_id"), BROADCAST_IDS), "set_id", "left_semi").groupBy(F.col("set_id").alias("u")).agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    sides = family.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("sides"))
    g = family.join(sides, "hub").withColumn("side", F.pmod(F.xxhash64("u"), "sides").cast("int"))
    g = g.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    g = g.select("hub", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "u", "label").join(bits_of, "u")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        left = _arrays(rows[rows["side"] == x])
        u, v = near(left, left if x == y else _arrays(rows[rows["side"] == y]))
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return keep.written(g.groupBy("hub", "x", "y").applyInPandas(run, "u bigint, v bigint").distinct(), "rest")


def _arrays(sets: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    return (*(sets[k].to_numpy(np.int64) for k in ("u", "label", "n")), [bytes(x) for x in sets["bits"]])


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of at least that many bytes at that width, as rows of words."""
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, width // 8), 0) for x in sketches], U).reshape(len(sketches), width // 8)


def near(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs of different labels whose sizes and sketches allow a similarity.

    left, right: ids, labels, sizes, sketches. Sketches of two widths are compared at the narrower one, as matrices.
    """
    out_u, out_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    place = lambda side: {w: np.array([i for i, x in enumerate(side[3]) if len(x) == w]) for w in {len(x) for x in side[3]}}
    lefts, rights = place(left), place(right)
    for w, i in lefts.items():
        # sizes within 4/3 have widths within a factor of two
        for w2 in (w // 2, w, 2 * w):
            if w2 not in rights:
                continue
            j, width = rights[w2], min(w, w2)
            x, y = _folded([left[3][k] for k in i], width), _folded([right[3][k] for k in j], width)
            n, labels = right[2][j], right[1][j]
            for k, row in zip(i, x):
                fits = np.flatnonzero((4 * n >= 3 * left[2][k]) & (4 * left[2][k] >= 3 * n) & (labels != left[1][k]))
                apart = np.bitwise_count(y[fits] ^ row).sum(1, dtype=np.int64)
                hit = j[fits[apart <= (n[fits] + left[2][k]) // 7]]
                out_u.append(np.full(len(hit), left[0][k]))
                out_v.append(right[0][hit])
    return np.concatenate(out_u), np.concatenate(out_v)


def cluster(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seen = keep.written(sets(docs, words), "sets")
    of_doc = seen.where("n is not null")
    kinds = of_doc.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("thin").alias("thin"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    kinds = keep.written(kinds.where("first is not null"), "kinds")
    total, lowest, highest = of_doc.agg(F.count(F.lit(1)), F.min(F.when(F.col("weak"), F.col("n"))), F.max(F.when(F.col("weak"), F.col("n")))).first()
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    # at most the mean number of shingles / HOT_SHARE hashes, whatever the number of documents
    frequent = seen.where("h is not null").groupBy("h").agg(F.sum("k").alias("k")).where(F.col("k") >= least).select("h").toPandas()["h"].to_numpy(np.int64)
    hot = spark.sparkContext.broadcast(np.sort(frequent.view(U)))
    weak_sizes = (lowest, highest) if lowest else None
    # a row for each size class
    sizes = of_doc.where("n > 0").groupBy(F.col("set_id").bitwiseAND(255).alias("size")).agg(F.max("n").alias("n"), F.sum("n").alias("all")).collect()
    # about half as many signatures as shingles
    place, n_buckets = places([(r["n"], r["all"]) for r in sizes], weak_sizes, parts_for(sum(r["all"] for r in sizes) // 2, BUCKET_SIGNATURES, spark))
    found = keep.written(_candidates(_blobs(docs.where("doc_id is not null"), place, n_buckets, hot, weak_sizes, words), n_buckets), "candidates")
    # a block and a member meet in one bucket only, so these rows are distinct
    stars = found.where("sig is not null").select("sig", "u")
    # hubs of a salted block are joined by a star of their own
    hubs = found.where("sig is not null").select("sig", F.col("v").alias("hub")).distinct()
    tops = hubs.groupBy("sig").agg(F.min("hub").alias("top"), F.max("hub").alias("last")).where("top <> last")
    tops = tops.join(hubs, "sig").where((F.col("top") != F.col("hub")) & _classes_match("top", "hub")).select(F.col("top").alias("u"), F.col("hub").alias("v"))
    pairs = found.where("sig is null").select("u", "v").union(tops).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    labels = components(_verified(pairs, kinds, docs, words, keep), keep)
    for seed in range(STAR_ROUNDS + 1):
        split = _split(stars, labels, keep)
        if split.isEmpty():
            break
        more = _more_stars(split, seed) if seed < STAR_ROUNDS else _rest(split, seen, keep)
        labels = _joined(labels, _verified(more, kinds, docs, words, keep), keep)
    # only sets of several documents or with links have another component than their own document
    if labels is not None:
        several = kinds.join(_few(labels.withColumnRenamed("node", "set_id"), BROADCAST_IDS), "set_id", "left").where("label is not null or copies > 1").select("set_id", "first", F.coalesce("label", "set_id").alias("label"))
        least_doc = keep.written(several.groupBy("label").agg(F.min("first").alias("component_id")), "least")
        named = several.join(_few(least_doc, BROADCAST_IDS), "label").select("set_id", "component_id")
    else:
        named = kinds.where("copies > 1").select("set_id", F.col("first").alias("component_id"))
    named = written(named, "jaccard-components")
    out = written(of_doc.select("doc_id", "n", "set_id"), "jaccard-documents")
    keep.drop()
    out = out.join(_few(named, BROADCAST_IDS), "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs without those that another document of their group, that of the smallest doc_id, stands for. Of repeated rows one stays; columns stay."""
    c = written(cluster(docs, words).where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    ids = docs.join(F.broadcast(c) if c.count() <= BROADCAST_IDS else c, "doc_id", "left_anti").select(*docs.columns)
    return ids.dropDuplicates(["doc_id", "text"]) if "text" in docs.columns and _repeats(docs) else ids


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 and doc_id is not null").isEmpty()


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
m AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, m.v FROM r JOIN m ON r.b = m.u)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
"""
