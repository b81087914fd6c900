from pyspark.sql import functions as F

from recollect.functions import text as T


def one(spark, value, f, day="2026-09-21"):
    return spark.createDataFrame([(value, day)], "x string, d string").select(f(F.col("x"), F.col("d"))).first()[0]


def test_relative_days(spark):
    cases = {"上周五见": "2026-09-18见", "这周三": "2026-09-23", "下周一": "2026-09-28", "昨天": "2026-09-20", "上个月搬了家": "搬了家", "以前周末": "以前周末"}
    for said, wanted in cases.items():
        assert one(spark, said, T.absolutize) == wanted
    assert one(spark, "昨天", T.absolutize, "no day") == "昨天"


def test_due(spark):
    assert one(spark, "下周三", T.norm_due) == "2026-09-30"
    assert one(spark, "无", T.norm_due) is None
    assert one(spark, "soon", T.norm_due) is None


def test_pairs_cross_signs(spark):
    cut = lambda s: one(spark, s, lambda x, d: T.tokenize(x))
    assert cut("猫，三岁") == ["猫三", "三岁"]
    assert cut("好") == ["好"]
    assert cut("") == [] and cut(None) == [] and cut("，。") == []
    assert len(cut("今天画室很安静")) == 6


def test_tokens_and_clip(spark):
    rows = spark.createDataFrame([("a" * 20,), ("",), (None,)], "x string").select(T.estimate_tokens(F.col("x"))).collect()
    assert [r[0] for r in rows] == [14, 1, 1]
    assert one(spark, "abcdefghij", lambda x, d: T.clip_to_tokens(x, 4)) == "abc…"
    assert one(spark, "abc", lambda x, d: T.clip_to_tokens(x, 0)) == ""
    assert one(spark, "abc", lambda x, d: T.clip_to_tokens(x, 9)) == "abc"


def test_escape_is_lossless(spark):
    for s in ("a\nb\r\nc", "\\n not a break", "\\\\n", "x\\"):
        line = one(spark, s, lambda x, d: T.escape(x))
        assert "\n" not in line and "\r" not in line
        assert one(spark, s, lambda x, d: T.unescape(T.escape(x))) == s


def test_mock_embedding(spark):
    import zlib

    import numpy as np

    got = np.array(one(spark, "我家 猫叫团子", lambda x, d: T.mock_embedding(x)))
    want = np.zeros(64)
    s = "我家猫叫团子"
    for i in range(len(s) - 1):
        want[zlib.crc32(s[i : i + 2].encode()) % 64] += 1
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-6)
    assert not any(one(spark, "", lambda x, d: T.mock_embedding(x)))


def test_past(spark):
    assert one(spark, "你上次说的猫", lambda x, d: T.past_mentioned(x))
    assert not one(spark, "你好", lambda x, d: T.past_mentioned(x))
    assert not one(spark, None, lambda x, d: T.past_mentioned(x))
