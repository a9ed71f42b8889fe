"""Secret scans with the frequency of ownership over the whole corpus.

Each text is searched for assigned secrets, access keys and hexadecimal keys (the base spans), and for bare tokens that
look random. The hash of every such value is counted by the distinct repositories and owners that hold it: a value of
many owners is a copied example, one of few owners that looks random is taken for live. The method adds spans of kind
`bare`: tokens without a keyword whose value is live elsewhere in the corpus, as an assigned secret or a key.

Values, not texts, go through the shuffle, as 64-bit hashes; counts are combined before it, so that a value copied a
billion times costs a row for each task.

Defined results: a null text is empty; null repositories and owners count as one each; repeated rows are scanned each, and
count as one repository if they share its name; ids that are no numbers come out null; very long texts are scanned whole;
an empty table gives no rows. `redacted` keeps every row, null texts and ids included, and all other columns as they are:
spans go with the row that they were found in, not with its id."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import with_rows, written

#: The patterns, the least lengths of what must match, and the order of kinds.
ASSIGN = re.compile(r'(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "bare")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MANY_OWNERS = 4
MANY_REPOSITORIES = 25
LEAST_BITS = 2.5


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value): leftmost matches of each kind that don't overlap; too short ones are dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def bare_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens of 20 or more characters with letters and digits, outside the base spans."""
    out = []
    for m in BARE.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not any(s < m.end() and m.start() < e for s, _, e, _ in taken):
            out.append((m.start(), 3, m.end(), v))
    return out


def bits(value: str) -> float:
    """Entropy of the value's characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


_SPANS = "array<struct<kind int, start long, end long, hash long, bits double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64()), ("bits", pa.float64())]))


def _with(rows: DataFrame, kept: Column, text_col: str, repo_col: str | None, owner_col: str | None) -> DataFrame:
    """(row, repo, owner, kept, spans: kind, start, end, hash of the value, its entropy) of with_rows()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for t in b.column("text").to_pylist():
                base = base_spans(t or "")
                found = sorted(base + bare_spans(t or "", base))
                spans.append([{"kind": k, "start": s, "end": e, "hash": xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63), "bits": bits(v)}
                              for s, k, e, v in found])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(spans, _ARROW)], [*keys, "spans"])

    pick = lambda c: F.coalesce((F.col("doc")[c] if c else F.lit(None)).cast("string"), F.lit(""))
    keys = ("row", "repo", "owner", "kept")
    given = rows.select("row", pick(repo_col).alias("repo"), pick(owner_col).alias("owner"), kept.alias("kept"), F.col("doc")[text_col].cast("string").alias("text"))
    return given.mapInArrow(run, T.StructType([*(given.schema[k] for k in keys), T.StructField("spans", T._parse_datatype_string(_SPANS))]))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories, keyed: it is a base span somewhere, live) of (hash, repo, owner, kind, bits)."""
    return candidates.groupBy("hash").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repositories"),
        F.max((F.col("kind") < 3).cast("int")).alias("keyed"), F.max("bits").alias("bits")).select(
        "hash", "owners", "repositories", (F.col("keyed") == 1).alias("keyed"),
        ((F.col("owners") < MANY_OWNERS) & (F.col("repositories") < MANY_REPOSITORIES) & (F.col("bits") >= LEAST_BITS)).alias("live"))


def _judged(d: DataFrame, wanted: str) -> DataFrame:
    """(row, found): the spans of scanned()'s rows for which `wanted` holds, with what the corpus knows of their values."""
    flat = d.where(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("s")).select("row", "repo", "owner", "s.*")
    known = ownership(flat)
    return flat.join(known.drop("bits"), "hash").where("kind < 3 or (keyed and live)").where(wanted).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("found"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = "doc_id",
                owner_col: str | None = "source") -> DataFrame:
    """A row per input row: doc_id, found: array of (kind, start, end, owners, repositories, live), by start and kind.

    found holds every base span, and those bare ones whose value is keyed and live."""
    rows = with_rows(docs)
    ids = F.col("doc")[id_col].try_cast("long").alias("doc_id")
    d = written(_with(rows, ids, text_col, repo_col, owner_col), "secrets")
    return d.select("row", "kept").join(_judged(d, "true"), "row", "left").select(F.col("kept").alias("doc_id"), F.coalesce("found", F.array().cast(
        "array<struct<start long, kind int, end long, owners long, repositories long, live boolean>>")).alias("found"))


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_bare, n_live) of secret_scan()'s rows."""
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_listed(F.filter("found", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        of(3).alias("n_bare"), F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = "doc_id",
             owner_col: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with the live spans of each text replaced by `mark`; copied examples stay. Of overlapping spans the union goes.

    Only rows with spans take part in joins, by their row number."""
    d = written(_with(with_rows(docs), F.col("doc"), text_col, repo_col, owner_col), "secrets")
    text, spans = F.col("kept")[text_col], F.col("found")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(spans, state, lambda a, x: F.struct(
        F.when(x["end"] <= a["at"], a["out"]).when(x["start"] < a["at"], a["out"]).otherwise(
            F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"),
        F.greatest(a["at"], x["end"]).alias("at")), lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    masked = [F.when(spans.isNotNull(), done).otherwise(text).alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in docs.columns]
    some = d.where(F.size("spans") > 0).join(_judged(d, "live"), "row", "left").select(*masked)
    return d.where(F.size("spans") == 0).select(*(F.col("kept")[c].alias(c) for c in docs.columns)).union(some)


def brute_digest(text: str) -> tuple[int, int, int, str]:
    """The base of one text, without shortcuts: for tests."""
    out, n = [], [0, 0, 0]
    for k, pattern in enumerate((ASSIGN, ACCESS, re.compile("[0-9a-f]+"))):
        for m in pattern.finditer(text):
            if len(m[2] if k == 0 else m[0]) >= LEAST[KINDS[k]]:
                n[k] += 1
                out.append((m.start(), k, m.end()))
    return (*n, hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)).encode()).hexdigest())
