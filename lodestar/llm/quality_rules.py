"""Host-level quality rules, built-in functions only.

Each document is measured (words, symbols, repeated lines and word triples), each measure gives a rule that it passes or
fails, failures are summed by host, each host's failure rate is shrunk towards the corpus by a beta prior fitted to all
hosts, and the host's verdict is joined back to its documents.

Defined results: a null text has no words; a null host is a host of its own; an empty table gives no rows; repeated rows
are measured and counted each; other columns of the input, whatever their names, are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: What separates words, and what counts as a symbol.
WORD = r"[^\x20\x09-\x0D]+"
NOT_SYMBOLS = "[^#*$%&|<>]+"

RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "n_dup_lines > 0 and 2 * n_dup_lines > n_lines",
}
#: A host is rejected if its shrunk failure rate of a rule is above this.
MAX_RATE = {"short": 0.9, "repeats": 0.7, "symbols": 0.7, "lines": 0.7}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words), one row per input row.

    Repeated triples are found inside the row: hashes of all triples are sorted with their places, neighbours with equal
    hashes are repeats, and the union of their three-word windows is counted. No row leaves its task."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"),
        F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("lines"),
    )
    d = d.select(
        "doc_id", "host", "n_symbols", F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > 3, F.transform(
            F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).alias("h"))
    d = d.withColumn("p", F.when(
        F.size("h") > F.size(F.array_distinct("h")),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(x["h"] == F.get("p", j)["h"], F.lit(False))
    d = d.withColumn("at", F.sort_array(F.filter(F.transform("p", lambda x, j: F.when(
        same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))), x["i"])), lambda x: x.isNotNull())))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct(
        (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def host_verdicts(docs: DataFrame) -> DataFrame:
    """From measured rows: (host, n_docs, host_rejected, and for each rule its shrunk failure rate rate_<rule>).

    The prior of a rule has the mean and variance of the hosts' raw rates (method of moments): with mean m and variance v
    its weight is s = m (1 - m) / v - 1, kept within [1, 10000] (v = 0: 10000), a = m s, b = (1 - m) s, and a host's rate
    becomes (failures + a) / (documents + s). Counts are combined before the shuffle, so a host with a third of all rows
    costs one row a task."""
    fails = docs.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *(F.sum(F.expr(rule).cast("long")).alias(f"fail_{k}") for k, rule in RULES.items()))
    prior = fails.agg(*(f(F.col(f"fail_{k}") / F.col("n_docs")).alias(f"{n}_{k}")
                        for k in RULES for n, f in (("m", F.avg), ("v", F.var_pop))))
    d = fails.crossJoin(F.broadcast(prior))  # one row
    for k in RULES:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        s = F.when(v > 1e-12, F.greatest(F.lit(1.0), F.least(F.lit(1e4), m * (1 - m) / v - 1))).otherwise(F.lit(1e4))
        d = d.withColumn(f"rate_{k}", F.round((F.col(f"fail_{k}") + m * s) / (F.col("n_docs") + s), 6))
    rejected = F.greatest(*((F.col(f"rate_{k}") > most).cast("int") for k, most in MAX_RATE.items())) == 1
    return d.select("host", "n_docs", rejected.alias("host_rejected"), *(f"rate_{k}" for k in RULES))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per document: its measures, base_failed, its host's shrunk rates, and kept.

    Measures are written once to the checkpoint folder and read twice. The verdict table has one row per host; the join
    is left to the adaptive planner, which broadcasts it when its measured size is small and splits a hot host else."""
    m = written(measured(docs, id_col, text_col, host_col), "quality-rules")
    hosts = host_verdicts(m)
    base = F.expr(f"({RULES['short']}) or ({RULES['repeats']})")
    joined = m.alias("m").join(hosts.alias("h"), F.col("m.host").eqNullSafe(F.col("h.host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~F.col("host_rejected")).alias("kept"), F.col("m.host").alias("host"), "host_rejected",
        *(f"rate_{k}" for k in RULES))


ORACLE = r"""
with d as (select doc_id, source as host, coalesce(text, '') as t, row_number() over () as k from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) as lines from d),
tri as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select k, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
rep as (select k, i from tri qualify count(*) over (partition by k, g) > 1),
cov as (select k, count(distinct j)::bigint as n from (select k, unnest([i, i + 1, i + 2]) as j from rep) group by k),
m as (select doc_id, host, len(w)::bigint as n_words,
  length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
  coalesce(cov.n, 0)::bigint as n_repeat_words from w left join cov using (k)),
f as (select *, n_words < 50 as r0, 100 * n_repeat_words > 50 * n_words as r1, 10 * n_symbols > word_chars as r2,
  n_dup_lines > 0 and 2 * n_dup_lines > n_lines as r3 from m),
h as (select host, count(*) as n, [sum(r0::int), sum(r1::int), sum(r2::int), sum(r3::int)] as x from f group by host),
p as (select i, avg(x[i] / n) as a, var_pop(x[i] / n) as v from h, range(1, 5) r(i) group by i),
s as (select *, case when v > 1e-12 then greatest(1, least(1e4, a * (1 - a) / v - 1)) else 1e4 end as s from p),
r as (select host, list(round((x[i] + a * s) / (n + s), 6) order by i) as rate from h, s group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 or r1 as base_failed,
  not (r0 or r1) and not (rate[1] > 0.9 or rate[2] > 0.7 or rate[3] > 0.7 or rate[4] > 0.7) as kept, f.host,
  (rate[1] > 0.9 or rate[2] > 0.7 or rate[3] > 0.7 or rate[4] > 0.7) as host_rejected,
  rate[1] as rate_short, rate[2] as rate_repeats, rate[3] as rate_symbols, rate[4] as rate_lines
from f join r on f.host is not distinct from r.host
"""
