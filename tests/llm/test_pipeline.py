import random
from datetime import datetime

import pytest
from test_packing import check
from test_similar import brute

import corpus_pipeline as P
from lodestar.llm import packing, toxicity
from lodestar.llm.shared import written


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices(["th", "on", "er", "an", "re", "in", "st"], k=rnd.randint(1, 4))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    passage = " ".join(rnd.choices(words, k=80))
    docs = [(i, text(rnd.randint(80, 300)), "en", f"src{i % 7}", 5) for i in range(300)]
    docs += [(1000 + i, text(60) + " idiot scum " + text(60) + " moron", "en", "src1", 5) for i in range(60)]
    docs += [(2000 + i, docs[i][1], None, None, None) for i in range(20)]
    docs += [(3000 + i, text(150) + " " + passage + " " + text(150), "en", "src1", 5) for i in range(10)]
    docs += [(4000, text(100) + " token = Zx81Qw77Lm20Pk39Rt55 " + text(100), "en", "src2", 5), (4001, None, None, None, None), (4002, "short", "en", "x", 1)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int(1000 <= d[0] < 2000)) for d in docs if d[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, passage


def test_stages(spark, corpus):
    folder, docs, passage = corpus
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "passages", "secrets", "packing"]
    df, at = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = df.dtypes
    for name, stage in P.STAGES[:-1]:
        df = written(stage(spark, df, folder), name)
        assert df.dtypes == columns
        at.append({r.doc_id: r for r in df.collect()})
    safe, one, cut, masked = at
    own = {d[0]: d[1] for d in docs}
    assert all(safe[i].text == own[i] for i in safe)
    assert not [i for i in safe if 1000 <= i < 2000] and [i for i in own if i not in safe and not 1000 <= i < 2000] == []
    ids = sorted(safe)
    comp = brute([own[i] for i in ids])
    assert set(one) == {ids[c] for c in comp} and not [i for i in one if 2000 <= i < 3000]
    assert set(cut) == set(one) and [i for i in cut if passage in (cut[i].text or "")] == [3000]
    assert all(cut[i].text == own[i] for i in cut if not 3000 < i < 4000) and all(r.text is None or r.n_chars == len(r.text) for r in cut.values())
    assert "token = Zx81" not in masked[4000].text and "[SECRET]" in masked[4000].text
    assert all(masked[i].text == cut[i].text for i in cut if i != 4000)
    last = P.STAGES[-1][1](spark, df, folder).collect()
    order = sorted(masked)
    place = {d: k for k, d in enumerate(order)}
    rows = [packing_row(r, place) for r in last]
    assert check(rows, [masked[d].text for d in order], 2048) == 0


class packing_row:
    def __init__(self, r, place):
        self.__dict__.update(r.asDict() | {"doc_id": place[r.doc_id]})


def test_run_equals_stages(spark, corpus):
    got = P.run(spark, corpus[0])
    assert got.columns == [x.split()[0] for x in packing.PIECES.split(", ")] and got.count() > 0


def test_rejected_documents_are_those_predicted(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus[0]}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    said = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert kept == {i for i, p in said.items() if not p}


def test_odd_rows_through_all_stages(spark, corpus):
    """Null and repeated ids, microseconds, clashing names, no n_chars; an empty table."""
    folder, docs, passage = corpus
    at = datetime(2024, 5, 1, 12, 30, 15, 123456)
    secret = "token = Zx81Qw77Lm20Pk39Rt55"
    rows = [(d[0], d[1], d[3], at, 1, "x", [1, None]) for d in docs[:40]]
    rows += [(None, "a null id with " + secret + " in it", None, None, None, None, None), (7, "another text of seven with " + secret + " again", "s", at, 2, "y", []),
             (7, None, "s", at, 3, None, None), (None, "", None, at, 4, "z", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, row timestamp, block int, extra string, kept array<int>").repartition(3)
    df = odd
    for name, stage in P.STAGES[:-1]:
        df = written(stage(spark, df, folder), name)
        assert df.dtypes == odd.dtypes
    got = df.collect()
    assert len(got) == 43 and all(r.row in (at, None) for r in got)  # null and empty are one group
    assert [r.text for r in got if r.doc_id is None] == ["a null id with [SECRET] in it"]
    assert sorted((r.text or "-")[:7] for r in got if r.doc_id == 7)[:2] == ["-", "another"] and not [r for r in got if "Zx81" in (r.text or "")]
    assert P.STAGES[-1][1](spark, df, folder).select("doc_id").distinct().count() == 41
    df = odd.limit(0)
    for name, stage in P.STAGES[:-1]:
        df = written(stage(spark, df, folder), name)
        assert df.dtypes == odd.dtypes and df.count() == 0
    assert P.STAGES[-1][1](spark, df, folder).count() == 0
