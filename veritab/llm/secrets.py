"""Secret scans: base patterns, then dictionary-primed zstandard novelty.

A candidate is a long run of key characters that stands shortly after a sensitive word. Its marginal size is what it adds to
the compressed size of its surroundings, when zstandard is primed with a dictionary of code and identifiers: a fixed list, and the
most frequent identifiers of the documents that have a sensitive word (`learn`). A run that
adds nearly as many bytes as random strings of its length and alphabet add in its place is incompressible: nothing near it and no
known identifier explains it. A run without digits must come nearer to them, because it may be a rare word. Its copies after
sensitive words are taken out of the surroundings first, so a repeated key is no less novel; a copy elsewhere makes it public.

A text is read once: words and runs are listed in order, and each run looks at the last word before it.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive; of novel spans those inside a base
span are left out; each row is judged by itself, so ties and repeated rows need no rule; other columns are kept by `redact`; a table without
sensitive words teaches no identifiers.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import compress

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Lower-case byte strings, one of which is in every text that ASSIGN matches.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Words that make what follows them sensitive.
SENSITIVE = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"credential", b"private_key", b"privatekey", b"private key", b"access_key", b"auth", b"bearer")
SENSITIVE_RE = re.compile("|".join(re.escape(w.decode()) for w in SENSITIVE), re.I | re.A)
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Parts of a candidate that count as copies of it where they recur.
PIECE = re.compile(r"[A-Za-z0-9]{16,}")
#: Characters after a sensitive word in which a candidate must begin, on its line or a later one, and characters of surroundings on either side.
REACH, AROUND = 48, 200
#: A candidate is reported from that many marginal bytes for each of a random string in its place or each of
#: its own, or from as many as the least of the random strings.
NOVELTY = 0.85
#: The same for a run without digits, which has only this way.
WORD_NOVELTY = 0.9
#: Identifiers that are learnt: so many at most, of documents with a sensitive word, that occur in so many of them.
LEARNT, LEARNT_DOCS = 4000, 5
IDENTIFIER = "[A-Za-z_]{6,15}"
#: Random strings that a candidate is compared with.
DRAWS = 5
#: Kinds of characters: a random string has all those of a kind that the candidate has, and its other characters as they are.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: What code and identifiers are made of; the dictionary that primes the compressor.
IDENTIFIERS = """
import from return class function def public private static const let var new null none true false self this async await
string integer boolean float double list dict map array object value values key keys name names index count length size type types
config configuration settings environment production development testing staging default example sample placeholder changeme
username user_name password passwd secret token api_key apikey access_key secret_key client_id client_secret auth authorization
authentication bearer credential credentials private_key public_key certificate session session_id cookie header headers request
response server client host hostname localhost port database connection connection_string endpoint service account project
http:// https:// www. .com .org .net .json .yaml .xml .html .txt .py .java .js /usr/local/bin /var/log /etc/ /home/user/
get_value set_value get_token set_token read_file write_file load_config save_config parse_json to_string from_string
getValue setValue getToken setToken readFile writeFile loadConfig saveConfig parseJson toString fromString
AAAAAAAAAAAAAAAA xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef
""".strip()


def alphabet(s: str) -> str:
    """The characters that a random string like s is made of."""
    for kind in ALPHABETS[:3]:
        if all(c in kind for c in s):
            return kind
    return "".join(sorted({c for x in s for c in next((k for k in ALPHABETS[2:] if x in k), x)}))


def learn(docs: DataFrame) -> str:
    """The LEARNT most frequent identifiers of the documents that have a sensitive word, the most frequent last, where zstandard finds them soonest."""
    some = docs.where(F.lower("text").rlike("|".join(re.escape(w.decode()) for w in SENSITIVE)))
    words = some.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEARNT_DOCS).orderBy(F.desc("k"), "w").limit(LEARNT)
    return " ".join(r["w"] for r in reversed(top.collect()))


class Scanner:
    def __init__(self, identifiers: str = "", novelty: float = NOVELTY) -> None:
        primed = zstandard.ZstdCompressionDict(f"{identifiers} {IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.size = lambda s: len(self.zstd.compress(s.encode("utf-8", "surrogatepass")))
        self.zstd = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False)
        self.novelty = novelty

    def marginal(self, text: str, a: int, b: int, runs: list[tuple[int, int]]) -> tuple[int, float]:
        """Compressed bytes that text[a:b] adds to its surroundings, and from how many on it is as novel as random strings in its place."""
        s, lo, hi = text[a:b], max(0, a - AROUND), min(len(text), b + AROUND)
        keep = bytearray(b"\1") * (hi - lo)
        copies = {s, *PIECE.findall(s)}
        for x, y in runs[bisect_right(runs, lo, key=lambda r: r[1]) : bisect_left(runs, hi, key=lambda r: r[0])]:
            if y <= a or x >= b:
                for copy in copies:
                    last = min(y, hi + len(copy))
                    at = text.find(copy, max(x, lo - len(copy)), last)
                    while at >= 0:
                        p, q = max(at, lo) - lo, min(at + len(copy), hi) - lo
                        keep[p:q] = bytes(max(q - p, 0))
                        at = text.find(copy, at + len(copy), last)
        before, after = ("".join(compress(text[x:y], keep[x - lo : y - lo])) for x, y in ((lo, a), (b, hi)))
        least, draw, letters = self.size(before + after), random.Random(s), alphabet(s)
        others = [self.size(before + "".join(draw.choices(letters, k=len(s))) + after) - least for _ in range(DRAWS)]
        usual = min(sum(others) / DRAWS, len(s))
        if not any(c.isdigit() for c in s):
            return self.size(before + s + after) - least, max(WORD_NOVELTY, self.novelty) * usual
        return self.size(before + s + after) - least, min(self.novelty * usual, min(others))

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind), by start and then kind as in KINDS."""
        if not text:
            return []
        low = text.encode("utf-8", "surrogatepass").lower()
        out: list[tuple[int, int, str]] = []
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        if b"akia" in low:
            out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        if any(w in low for w in SENSITIVE):
            out += self.novel(text, out)
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))

    def novel(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        ends = [m.end() for m in SENSITIVE_RE.finditer(text)]
        found: list[tuple[int, int]] = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            before, within = bisect_right(ends, a), bisect_right(ends, b - LEAST)
            if before and a - ends[before - 1] < REACH:
                found.append((a, b))
            if within > before:  # the run has a word in it, and what follows the last one is a run too
                found.append((ends[within - 1], b))
        out, done, known = [], -1, [(x, y) for x, y, _ in sorted(base)]
        for a, b in found:
            inside = bisect_right(known, (a, len(text)))
            if b <= done or any(b <= y for _, y in known[max(0, inside - len(KINDS)) : inside]):
                continue
            own, least = self.marginal(text, a, b, found)
            if own >= least:
                out.append((a, b, "novel"))
                done = b
        return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, starts, ends, kinds."""
    small_batches(docs.sparkSession)
    identifiers = learn(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(identifiers)
        for b in batches:
            found = [s.spans(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "starts": [[x[0] for x in f] for f in found], "ends": [[x[1] for x in f] for f in found], "kinds": [[x[2] for x in f] for f in found]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, starts array<int>, ends array<int>, kinds array<string>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark; n_chars, where there is such a column, follows. No row is dropped."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    identifiers = learn(docs)

    def run(batches):
        s = Scanner(identifiers)
        for b in batches:
            i = b.schema.get_field_index("text")
            texts = []
            for t in b.column(i).to_pylist():
                at, out = 0, []
                for x, y, _ in s.spans(t):
                    if y > at:
                        out += [t[at : max(at, x)], mark] if x >= at else []
                        at = y
                texts.append("".join([*out, t[at:]]) if out else t)
            b = b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))
            yield b

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    identifiers = learn(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(identifiers)
        for b in batches:
            found = [s.spans(t) for t in b["text"]]
            n = {k: [sum(x[2] == k for x in f) for f in found] for k in KINDS}
            base = [joined([x for x in f if x[2] != "novel"]) for f in found]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in base], "spans": [joined(f) for f in found], "n_novel": n["novel"]})

    return docs.mapInPandas(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint")


def base_query(spark, sf_dir: str) -> DataFrame:
    """The base spans alone, which SQL can express."""
    return query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _kind_sql(place: int, kind: str, pattern: str, ok: str) -> str:
    """The spans of a kind: a match begins where the pieces between matches, and the matches before it, end."""
    each = f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d"
    at = "list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)"
    return f"SELECT doc_id, {place} AS k, '{kind}' AS kind, {at} AS a, m[i] AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({each})) WHERE {ok}"


_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_kind_sql(0, "assign", _ASSIGN, f"length(regexp_extract(m[i], '{_ASSIGN}', 2)) >= 8")}
 UNION ALL {_kind_sql(1, "access", "AKIA[A-Z0-9]+", "length(m[i]) >= 16")}
 UNION ALL {_kind_sql(2, "hex", "[0-9a-f]+", "length(m[i]) >= 32")}),
j AS (SELECT doc_id, string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(s) AS BIGINT) AS VARCHAR), ',' ORDER BY a, k) AS spans,
 count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2 FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""
