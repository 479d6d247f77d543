"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring symbols that occurs inside no token of the vocabulary can never be merged over: no merge result could
hold it. Such pairs are certain cuts. Each word is split there, its fragments are encoded independently, and the ids
are concatenated; fragments recur far more often than words, so most of them come from a bounded cache.

The tokenizer's file gives the vocabulary, merges, end-of-word suffix and added tokens; normaliser and word pattern are those of
files of this kind: NFC, white space, lower case, a regular expression, bytes as printable characters.

Defined results: a null text is an empty one and has no tokens; null ids decode to an empty text, null and unknown ids within them are skipped; an added token's own string in a text becomes its id, as in
the library; rows are encoded one by one; other columns are kept by `encode`.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

#: Entries of the cache of words, and half as many of the cache of fragments; a full cache is emptied. About 55 MB.
CACHE = 200_000
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(1)
def _byte_chars() -> list[str]:
    """The printable character of each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class Codec:
    def __init__(self, file: str) -> None:
        import regex

        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.chars = _byte_chars()
        self.word = regex.compile(WORD)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        inside = set()
        for token in self.vocab:
            t = token.removesuffix(self.suffix)
            inside.update(zip(t, t[1:]))
        #: Pairs of characters that occur inside a token; all others are cuts.
        self.inside = inside
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, list[int]] = {}

    def fragments(self, word: str) -> list[str]:
        """word, as printable characters, cut at the forced boundaries."""
        inside = self.inside
        cuts = [i for i, p in enumerate(zip(word, word[1:]), 1) if p not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, None])] if cuts else [word]

    def merge(self, symbols: list[str]) -> list[int]:
        """Ids of a fragment: the pair of the lowest rank, of equal ones the leftmost, is merged until none is left."""
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return [self.vocab[s] for s in symbols if s in self.vocab]

    def merge_long(self, symbols: list[str]) -> list[int]:
        """The same by a heap over a linked list, for words of any length."""
        import heapq

        n = len(symbols)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], nxt[i] = a + b, False, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [self.vocab[s] for s, k in zip(symbols, alive) if k and s in self.vocab]

    def encode_word(self, word: str) -> bytes:
        """Ids, as little-endian 32 bits, of a normalised word."""
        chars = self.chars
        ids: list[int] = []
        cut = self.fragments(word if word.isascii() and word.isprintable() else "".join([chars[b] for b in word.encode("utf-8", "surrogatepass")]))
        for k, part in enumerate(cut):
            key = part + "\0" if k == len(cut) - 1 else part
            got = self.parts.get(key)
            if got is None:
                symbols = [*part]
                if k == len(cut) - 1:
                    symbols[-1] += self.suffix
                got = (self.merge if len(symbols) <= 64 else self.merge_long)(symbols)
                if len(self.parts) >= CACHE // 2:
                    self.parts.clear()
                if len(part) <= 64:
                    self.parts[key] = got
            ids += got
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian 32 bits."""
        if not text:
            return b""
        ids: list[bytes] = []
        known, words = self.words, self.words.get
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.added:
                ids.append(struct.pack("<I", self.added[piece]))
                continue
            # the library lowers character by character, so no sigma is a final one
            low = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            found = self.word.findall(low)
            got = [*map(words, found)]
            if None in got:
                for i, g in enumerate(got):
                    if g is None:
                        w = found[i]
                        got[i] = g = words(w)
                        if g is None:
                            got[i] = g = self.encode_word(w)
                            if len(w) <= 64:
                                if len(known) >= CACHE:
                                    known.clear()
                                known[w] = g
            ids += got
        return b"".join(ids)

    def decode(self, ids) -> str:
        """The library's decode of a file without a decoder: the tokens, joined by spaces."""
        tokens = self.tokens
        try:
            return " ".join([*map(tokens.__getitem__, ids)])
        except KeyError:
            return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(2)
def codec_of(file: str) -> Codec:
    """One codec for a Python worker, which keeps its caches over the tasks that it runs."""
    return Codec(file)


def load(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def _shared(spark: SparkSession, path: str | None):
    """The tokenizer's file, of a few MB at most, for the executors: they need not have it themselves."""
    file = load(path)
    if len(file) > 64 << 20:
        raise ValueError("the tokenizer's file has over 64 MB")
    return spark.sparkContext.broadcast(file)


def encode(docs: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """docs with a column of the ids of text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = _shared(spark, path)

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(shared.value)
        for t in texts:
            yield pd.Series([np.frombuffer(codec.encode(x), "<u4").astype("int32") for x in t])

    return docs.withColumn(ids, run("text"))


def decode(tokens: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """tokens with a column of the text of their ids."""
    shared = _shared(tokens.sparkSession, path)

    @F.pandas_udf("string")
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(shared.value)
        for r in rows:
            yield pd.Series(["" if x is None else codec.decode([int(i) for i in x if i is not None and i == i]) for x in r])

    return tokens.withColumn(text, run(ids))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what decoding them gives."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = _shared(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(shared.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            got = [codec.encode(t) for t in b["text"]]
            said = [sha(codec.decode(np.frombuffer(g, "<u4").tolist()).encode("utf-8")) for g in got]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": [len(g) // 4 for g in got], "ids_sha256": [sha(g) for g in got], "decoded_sha256": said})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
