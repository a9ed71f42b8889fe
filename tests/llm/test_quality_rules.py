import random
import re

from pyspark.sql import functions as F

from lodestar.llm import quality_rules as Q
from lodestar.llm.shared import ranked


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {x for x in tri if tri.count(x) > 1}
    at = {j for i, x in enumerate(tri) if x in many for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(at)


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n\nx ", "é#ü *&|<> $%\x0b\x0cz", "a b a b a b", "one two three four " * 30,
         "\xa0nbsp \x85 words", "l\n" * 5, "a\r\nb\r\na\r\nb", "𝒳 𝒴 𝒳 𝒴 𝒳"]


def test_measures(spark):
    rnd = random.Random(1)
    texts = TEXTS + [" ".join(rnd.choices(["aa", "b", "cé"], k=rnd.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "h", "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, host string, n_words int")
    got = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_bad_host_is_rejected_and_small_ones_shrink(spark):
    good = " ".join(f"word{i}" for i in range(80))
    bad = "### *** " * 5 + good.replace("word", "#$%&")
    rows = [(i, good, f"good{i % 40}") for i in range(4000)] + [(5000 + i, bad, "bad") for i in range(400)] + [(9000, good, "bad"), (9001, bad, "tiny"), (9002, good, "tiny2")]
    rows += [(9100, good, None), (9101, "short", None)]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[9000].host_rejected and not got[9000].kept and not got[9000].base_failed
    assert got[0].kept and not got[9001].host_rejected and got[9002].kept and got[9100].kept and not got[9101].kept
    assert got[5000].rate_symbols < 1 and got[9001].rate_symbols < 0.7


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x")], "doc_id long, text string, source string")
    assert Q.quality_rules(docs).count() == 2 and Q.quality_rules(docs.limit(0)).count() == 0


def test_ranks_are_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = ranked(df, ["k"], "id", salts=7).collect()
    for k in range(3):
        n = sum(r.k == k for r in got)
        assert sorted(r["rank"] for r in got if r.k == k) == list(range(n))
    assert ranked(df.limit(0), ["k"], "id").count() == 0
