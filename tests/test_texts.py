import pytest
from pyspark.sql import functions as F

from lodestar.functions import formats as M
from lodestar.functions import texts as T
from lodestar.operators import catalog_ops as O


def values(spark, expr, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(expr).collect()]


def test_basic_tokens(spark):
    x = F.col("x")
    got = values(spark, T.basic_tokens(x), ["节日庆典", "Hello世界", "Café​, ok!\x00", "  ", "a\tb\nc", "don't-stop…", "�x𠀀y", None])
    assert got == [list("节日庆典"), ["hello", "世", "界"], ["cafe", ",", "ok", "!"], [], ["a", "b", "c"], ["don", "'", "t", "-", "stop", "…"], ["x", "𠀀", "y"], None]


def test_basic_tokens_equal_their_steps(spark):
    """Every character alone, between letters and after a mark; the steps one after another, accents by Python."""
    chars = [chr(c) for c in range(0x11FFF) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x16000, 0x17000)] + [
        chr(c) for a, b in ((0x1D100, 0x1D200), (0x1E000, 0x1F000), (0x20000, 0x20010), (0x2F800, 0x2FA20), (0xE0100, 0xE0110)) for c in range(a, b)]
    rows = ["".join(f"A{c}B {c}\u0301 Σ{c} É{c}," for c in chars[i:i + 16]) for i in range(0, len(chars), 16)] + [f"\u302e\u0301{c}\u0327x" for c in "aé한"]
    df = spark.createDataFrame([(r,) for r in rows], "x string").repartition(4)
    lowered = F.lower(T.spaced_ideographs(T.clean(F.col("x"))))
    stripped = df.select("x", T._strip_accents(lowered).alias("t"))
    want = dict(map(tuple, stripped.select("x", F.flatten(F.transform(T.white_tokens(F.col("t")), T.split_punctuation))).collect()))
    got = dict(map(tuple, df.select("x", T.basic_tokens(F.col("x"))).collect()))
    assert len(got) == len(set(rows)) and [r for r in rows if got[r] != want[r]] == []


def test_basic_tokens_of_single_characters_equal_their_steps(spark):
    """A text for every character, so that those which are mapped in one step aren't hidden by others that take all steps."""
    chars = [chr(c) for a, b in ((0, 0xD800), (0xE000, 0x12000), (0x13430, 0x13460), (0x16000, 0x17000), (0x1D100, 0x1D200), (0x1E000, 0x1F000), (0x2F800, 0x2FA20))
             for c in range(a, b)]
    df = spark.createDataFrame([(f"A{c}B {c}\u0301 É{c},",) for c in chars], "x string").repartition(4).cache()
    lowered = F.lower(T.spaced_ideographs(T.clean(F.col("x"))))
    steps = df.select("x", T._strip_accents(lowered).alias("t")).select("x", F.flatten(F.transform(T.white_tokens(F.col("t")), T.split_punctuation)).alias("want"))
    wrong = steps.withColumn("got", T.basic_tokens(F.col("x"))).where("not got <=> want")
    assert wrong.take(5) == [] and df.count() == len(chars)


def test_only_unsettled_texts_take_all_steps(spark, monkeypatch):
    x = F.col("x")
    monkeypatch.setattr(T, "strip_accents", lambda *_: F.lit("by steps"))
    latin = ["Plain, text\x00s", "L'ÉCOLE straße İ\xad\x85½", "Ạ Привет “x”", "e\u0301 漢字", ""]
    assert values(spark, T.basic_tokens(x), latin) == [
        ["plain", ",", "texts"], ["l", "'", "ecole", "straße", "i½"], ["a", "привет", "“", "x", "”"], ["e", "漢", "字"], []]
    assert values(spark, T.basic_tokens(x), ["ΟΔΟΣ", "한", "a\u200bé", "\ufffd", "\u302e\u0301", "\U0010fffe"]) == [["by", "steps"]] * 6


def test_only_what_counts_goes_to_python(spark, monkeypatch):
    vocab = T.load_vocabulary(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "##a"])
    seen = spark.createDataFrame([(["", None, "a" * 100_000, *["a"] * 5000],)], "tokens array<string>")
    assert T.wordpiece(seen, "tokens", vocab).first().ids == [2, 1, *[4] * 49, 3]
    plan = T.wordpiece(seen, "tokens", vocab).select("ids")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "slice(filter(tokens" in plan
    texts = spark.createDataFrame([("Café",), ("한",), ("plain",)], "x string")
    sent = []
    monkeypatch.setattr(T, "_strip_accents", lambda c: sent.append(c) or c)
    texts.select(T.strip_accents(F.col("x"))).collect()
    assert [r[0] for r in texts.select(sent[0]).collect()] == [None, "한", None]


def test_wordpiece(spark):
    vocab = T.load_vocabulary(["[PAD]", "[UNK]", "", "[CLS]\r", "[SEP]", "un", "##aff", "##able", "a", "##a"])
    assert vocab["[CLS]"] == 2 and vocab["un"] == 4
    assert T.pieces_of("unaffable", vocab) == ["un", "##aff", "##able"] and T.pieces_of("unx", vocab) == ["[UNK]"]
    assert T.pieces_of("a" * 200, vocab) == ["a"] + ["##a"] * 199 and T.pieces_of("a" * 201, vocab) == ["[UNK]"]
    df = spark.createDataFrame([(["unaffable", "zz"],), ([],), (None,), (["a"] * 60,)], "tokens array<string>")
    got = [r.ids for r in T.wordpiece(df, "tokens", vocab).collect()]
    assert all(len(g) == 52 for g in got) and got[0][:7] == [2, 4, 5, 6, 1, 3, 0] and got[1][:3] == got[2][:3] == [2, 3, 0]
    assert got[3] == [2] + [7] * 50 + [3]
    with pytest.raises(ValueError, match="lacks"):
        T.load_vocabulary(["a"])


def test_identity_and_guards(spark):
    got = spark.createDataFrame([("photo-library-id-1", b"\1\2\3"), (None, b"\4\5\6"), (" \n", b"\4\5\6")], "i string, p binary").select(T.identity(F.col("i"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["photo-library-id-1", "asset-787c798e39a5bc19", "asset-787c798e39a5bc19"]
    assert values(spark, T.is_backed(F.col("x")), ["a", "", None]) == [True, False, False]
    assert values(spark, T.trimmed(F.col("x")), ["　 a b\xa0\n", ""]) == ["a b", ""]
    assert values(spark, O.failure_kind(F.col("x")), ["推理失败", "manifest 图片", "相册", "不可读", "输入", "?", " ", None]) == [
        "model", "storage", "library", "resource", "input", "other", "unfinished", "unfinished"]


def test_formats(spark):
    assert values(spark, M.duration_text(F.col("x")), [1000.0, 999.4, 100.0, 1.0, 0.126], "double") == ["1.00s", "999ms", "100ms", "1.0ms", "0.13ms"]
    assert values(spark, M.eta_text(F.col("x")), [59.4, 60.0, 3599.0, 3600.0, 3660.0], "double") == ["59 s", "1 min", "59 min", "1 h", "1 h 1 min"]
    assert values(spark, M.speed_text(F.col("x")), [2.0, 0.5, 0.0], "double") == ["2.0 items/s", "2.0 s/item", ""]
    assert values(spark, M.progress(F.col("x"), F.lit(4)), [1, 4]) == [0.25, 1.0] and values(spark, M.progress(F.lit(1), F.col("x")), [0], "int") == [0.0]


def test_token_texts(spark):
    vocab = T.load_vocabulary(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a"])
    assert spark.createDataFrame([([2, 4, 9, 3],)], "i array<long>").select(T.token_texts(F.col("i"), vocab)).first()[0] == ["[CLS]", "a", "[UNK]", "[SEP]"]
