import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import fill_in_middle as fim


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def some_texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choices(["a", "b ", "<", "P", "S", ">", "é", "漢", "🙂", "\n", "\0"], k=rnd.choice([1, 5, 127, 128, 129, 700, 4000]))) for _ in range(150)]
    made += ["x" * k for k in (127, 128, 129, 255, 256, 257, 4096)] + ["🙂" * k for k in (31, 32, 33, 500)]
    for at in (0, 1, 125, 126, 127, 128, 254, 255, 256, 257, 300):  # markers over the ends of lines and chunks
        made += ["é" * (at // 2) + "y" * (at % 2) + m + "z" * 300 for m in ("<P>", "<S>", "<M>", "<<M>", "<P", "<P<S>", "<X>", "<p>")]
    return made


@pytest.mark.parametrize("chunk", [128, 256, 32768])
def test_equals_plain_version(spark, chunk):
    texts = [*some_texts(), None, "", "same", "same"]
    rows = [(i, t, "k", 7) for i, t in enumerate(texts)] + [(3, "repeated row", "k", 7)] * 2 + [(None, "no id " * 90, "k", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes string, n int").repartition(5)
    got = fim.fill_in_middle(docs, chunk=chunk)
    want = sorted(((i, *plain(i, t)) for i, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = got.select(fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t, *_ in rows)


def test_deep_folds(spark, monkeypatch):
    monkeypatch.setattr(fim, "FAN", 3)
    texts = ["long é" * k for k in (100, 900, 3000)] + ["q" * 9000 + "<M>" + "r" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in fim.fill_in_middle(docs, chunk=128).collect()}
    assert got == {i: plain(i, t) for i, t in enumerate(texts)}


def test_functions_compose_associatively(spark):
    text = ("ab<" + "P>é漢🙂<<S" + ">x<M").encode() * 40
    cuts = [0, 1, 3, 4, 9, 11, 130, 131, 132, 300, len(text)]
    parts = [(0, i, text[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    fs = fim.functions_of(spark.createDataFrame(parts, "row long, part long, bytes binary"))
    whole = fim.functions_of(spark.createDataFrame([(0, 0, text)], "row long, part long, bytes binary")).first().f
    fold = lambda cond: fs.where(cond).agg(fim.composed(F.transform(F.array_sort(F.collect_list(F.struct("part", "f"))), lambda x: x["f"])).alias("f"))
    assert fold("true").first().f == whole
    two = fold("part < 4").union(fold("part >= 4")).collect()
    left, right = two[0].f, two[1].f
    assert [right.ends[s] for s in left.ends] == whole.ends
    assert [p + right.points[s] for p, s in zip(left.points, left.ends)] == whole.points
    assert whole.points[0] == len(text.decode()) and whole.hits[0] == sum(text.decode().count(m) for m in ("<P>", "<S>", "<M>"))


def test_empty_table_and_string_ids(spark):
    assert fim.digest(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    docs = spark.createDataFrame([("12", "some text here"), ("x", "other")], "doc_id string, text string")
    got = {r.doc_id: r for r in fim.fill_in_middle(docs).collect()}
    assert tuple(got[12])[1:] == plain(12, "some text here") and set(got) == {12, None}
