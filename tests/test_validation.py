import json

from pyspark.sql import functions as F

from lodestar.functions import formats as M
from lodestar.operators import catalog_ops as O
from lodestar.operators import validation as R
from lodestar.sources import golden


def test_reports_of_golden_cases(spark, tmp_path):
    tolerances = {"token_ids_exact_match": True, "text_embedding_cosine_min": 0.99, "image_preprocess_cosine_min": 0.99, "image_preprocess_abs_diff_max": 0.01, "image_embedding_cosine_min": 0.9}
    doc = {"tolerances": tolerances, "text_cases": [{"id": k, "text": k, "token_ids": [1, 2], "text_embedding": [1.0, 0.0]} for k in "abcd"],
           "image_cases": [{"id": k, "image": k, "image_embedding": [0.0, 1.0]} for k in "xyz"]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = golden.read(spark, f"file://{tmp_path}/g.json")
    own = spark.createDataFrame([("a", [1, 2], [2.0, 0.0]), ("b", [1, 3], [1.0, 1.0]), ("c", [1, 2], [1.0])], "id string, own_token_ids array<int>, own_embedding array<float>")
    got = {(r.kind, r.id): (r.passed, r.message) for r in R.text_results(g, own).collect()}
    assert got["tokens", "a"] == (True, None) == got["text embedding", "a"] and got["tokens", "b"] == (False, "token 1 differs")
    assert got["text embedding", "b"] == (False, "cosine 0.7071, at least 0.9900") and got["text embedding", "c"] == (False, "cosine -1.0000, at least 0.9900")
    assert got["tokens", "d"] == (False, "no tokens") and not got["text embedding", "d"][0]
    loose = g.withColumn("tolerances", F.col("tolerances").withField("token_ids_exact_match", F.lit(False)))
    assert R.text_results(loose, own).where("kind = 'tokens' and not passed").count() == 0
    images = spark.createDataFrame([("x", [0.5, 1.0], [0.505, 1.0], [0.0, 3.0]), ("y", [0.5, 1.0], [0.6, 1.0], [0.0, 3.0]), ("z", None, None, [1.0, 0.0])],
                                   "id string, tensor array<double>, own_tensor array<double>, own_embedding array<double>")
    got = {(r.kind, r.id): r.passed for r in R.image_results(g, images).collect()}
    assert got == {("image", "x"): True, ("image", "y"): False, ("image", "z"): True, ("image embedding", "x"): True, ("image embedding", "y"): True, ("image embedding", "z"): False}
    told = {r.kind: r for r in R.report(R.text_results(g, own), most=1).collect()}
    assert (told["tokens"].passed, told["tokens"].checks, told["tokens"].failures, told["tokens"].messages) == (False, 4, 2, "b: token 1 differs")
    fine = R.report(R.similarity_results(spark.createDataFrame([("p", 0.5, 0.501, 0.01)], "id string, similarity double, own double, most double"))).first()
    assert (fine.passed, fine.failures, fine.messages) == (True, 0, None)


def test_time_ago(spark):
    far = {0: "now", 1: "1 sec. ago", 59: "59 sec. ago", 60: "1 min. ago", 7199: "1 hr. ago", 86400: "1 day ago", 200000: "2 days ago", 700000: "1 wk. ago", 3_000_000: "1 mo. ago",
           70_000_000: "2 yr. ago", -61: "in 1 min.", -180000: "in 2 days"}
    rows = spark.createDataFrame([(k, v) for k, v in far.items()], "k long, want string")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    assert all(r[0] == r[1] for r in rows.select(M.time_ago(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("k")), now), "want").collect())


def test_tally_by_source_and_offsets(spark):
    log = spark.createDataFrame([("a", "success"), ("a", "failure"), ("b", "cancelled")], "source string, status string")
    assert {tuple(r) for r in O.tally(log, "status", "source").collect()} == {("a", 1, 1, 2), ("b", 0, 0, 0)} and tuple(O.tally(log, "status").first()) == (1, 1, 2)
    rows = spark.createDataFrame([(i % 2, i, i) for i in range(100)], "g int, i int, n int").repartition(7)
    got = {r.i: r.offset for r in O.with_offsets(rows, ["g"], "i", "n").collect()}
    assert got == {i: sum(range(i % 2, i, 2)) for i in range(100)}
