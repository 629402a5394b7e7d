import re

import pytest
from pyspark.sql import functions as F

from feltgrid.domain import EMOTIONS
from feltgrid.functions import dates, metrics, parsing, text


def column(spark, values, expression, kind="string"):
    """Values of an expression over one column ``v``, in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def test_clean_text_follows_pattern_order(spark):
    values = [
        "看http://t.cn/abc你好 世界", "回复@某人:好的", "转//@甲:乙", "哈哈[哈哈]笑", "#话题#内容",
        "　全角　空格　", "nan", None, "", "a\n\tb", "#a# #b", "[未闭合",
    ]
    expected = ["看 世界", "好的", "转乙", "哈哈笑", "话题内容", "全角 空格", "", "", "", "a b", "a #b", "[未闭合"]
    assert column(spark, values, text.clean_text("v")) == expected


def test_count_chars(spark):
    assert column(spark, ["你好abc世界", "abc", ""], text.count_chars("v")) == [4, 0, 0]
    assert column(spark, ["ab1é"], text.count_chars("v", r"\p{L}")) == [3]


def test_parse_dates_weeks_months(spark):
    values = ["2021-01-03", "2019-12-30 10:11:12", "2020/3/5", "20200305", "2020-03-05T01:02:03", "", "nan", "2020-13-01", None]
    stamp = dates.parse_created_at("v")
    assert column(spark, values, dates.iso_week(stamp)) == [
        "2020-W53", "2020-W01", "2020-W10", "2020-W10", "2020-W10", None, None, None, None]
    assert column(spark, values, dates.month_key(stamp))[:4] == ["2021-01", "2019-12", "2020-03", "2020-03"]


def test_week_labels(spark):
    weeks = ["2020-W01", "2020-W10", "2020-W53", "2020-W09", "bad"]
    assert column(spark, weeks, dates.week_monday("v").cast("string")) == [
        "2019-12-30", "2020-03-02", "2020-12-28", "2020-02-24", None]
    assert column(spark, weeks, dates.week_short_range("v"))[:4] == [
        "2019年12月30日-2020年1月5日", "3月2日-8日", "2020年12月28日-2021年1月3日", "2月24日-3月1日"]
    assert column(spark, weeks, dates.week_full_range("v"))[1] == "2020年3月2日-3月8日"
    assert column(spark, weeks, dates.week_axis_range("v"))[1] == "03.02-03.08"
    assert column(spark, ["2020-01", "x"], dates.month_label("v")) == ["2020年1月", "x"]
    assert column(spark, ["2020-11", "x"], dates.month_short_label("v")) == ["11月", "x"]


def test_province_names(spark):
    values = [" 北京市", "新疆维吾尔自治区", "内蒙古自治区", "香港特别行政区", "宁夏回族自治区", "广东", "某市省", None]
    assert column(spark, values, text.normalise_province("v")) == ["北京", "新疆", "内蒙古", "香港", "宁夏", "广东", "某", ""]
    assert column(spark, ["北京 ", "海外", "None", "", "海南"], text.is_valid_province("v")) == [True, False, False, False, True]


def test_reject_order(spark):
    rows = [(None, "短", "未知"), ("2020-01-01", "短", "未知"), ("2020-01-01", "一二三四五六七八九十", "未知"),
            ("2020-01-01", "一二三四五六七八九十", "北京")]
    df = spark.createDataFrame(rows, "d string, t string, p string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    out = [r[0] for r in df.select(text.reject_reason("d", "t", "p")).collect()]
    assert out == ["bad_date", "too_short", "unknown_province", None]
    assert [r[0] for r in df.select(text.reject_reason("d", "t", "p", keep_unknown=True)).collect()][2] is None


def test_token_rules(spark):
    values = ["a", "http", "abcd", "abcde", "12.5", "你好", "——", "__", "x1", "好"]
    assert column(spark, values, text.is_valid_token("v")) == [
        False, False, False, True, False, True, False, False, True, False]
    df = spark.createDataFrame([("你好", "n"), ("你好", "p"), ("你好", "")], "w string, p string")
    assert [r[0] for r in df.select(text.is_valid_token("w", "p")).collect()] == [True, False, True]


def scores(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{e} double" for e in EMOTIONS))


def test_dominant_ties(spark):
    df = scores(spark, [(1 / 6,) * 6, (0.1, 0.3, 0.3, 0.1, 0.1, 0.1), (0.1, 0.1, 0.1, 0.1, 0.1, 0.5)])
    out = df.select(metrics.dominant(EMOTIONS).alias("a"), metrics.dominant_for_display(EMOTIONS).alias("b")).collect()
    assert [r.a for r in out] == ["joy", "sadness", "neutral"]
    assert [r.b for r in out] == ["neutral", "sadness", "neutral"]


def test_severity_and_deviation(spark):
    assert column(spark, [2.5, -2.9, 3.0, 3.4999, 3.5, -99.0, 100.0], metrics.severity("v"), "double") == [
        "moderate", "moderate", "severe", "severe", "extreme", "extreme", "moderate"]
    df = spark.createDataFrame(
        [(1.025, 1.0), (0.5, 1.0), (1.0, 1.0), (0.997, 1.0), (1.0, 0.0), (1.0, None), (-1.0, -2.0), (1.035, 1.0)], "v double, e double")
    got = [r[0] for r in df.select(metrics.deviation_pct("v", "e")).collect()]

    def by_hand(v, e):
        return "N/A" if e is None or abs(e) < 1e-8 else f"{(v - e) / abs(e) * 100:+.0f}%"

    assert got == [by_hand(r.v, r.e) for r in df.collect()]
    assert column(spark, ["+12%", "-3%", "N/A", "+0%"], metrics.deviation_sentence("v")) == [
        "比过去 4 周高出 12%", "比过去 4 周低 3%", "N/A", "比过去 4 周低 0%"]


def test_bands(spark):
    assert column(spark, [4.0, -3.2, 2.5, 1.0], metrics.z_text("v"), "double") == ["极端异常", "强烈异常", "明显偏高", "轻微波动"]
    assert column(spark, [0.15, 0.2, 0.45, 0.6, 0.61], metrics.map_bucket("v"), "double") == [0, 1, 2, 3, 4]
    assert column(spark, [0.06, 0.03, 0.0, -0.02, -0.05], metrics.trend_text("v"), "double") == [
        "明显升高", "小幅升高", "基本稳定", "小幅下降", "明显下降"]
    assert column(spark, [0, 5, 6], metrics.cluster_name("v"), "int") == ["高情绪强度型", "低表达型", "Cluster 6"]


def test_score_error(spark):
    rows = [(0.5, 0.1, 0.1, 0.1, 0.1, 0.1), (0.531, 0.1, 0.1, 0.1, 0.1, 0.1), (-0.01, 0.2, 0.2, 0.2, 0.2, 0.21),
            (None, 0.2, 0.2, 0.2, 0.2, 0.2), (0.4, 0.1, 0.1, 0.1, 0.1, 0.171)]
    out = [r[0] for r in scores(spark, rows).select(metrics.score_error()).collect()]
    assert out == [None, "sum_error:1.031", "score_out_of_range:joy=-0.01", "score_out_of_range:joy=None", None]


def test_sum_valid_rate_counts_missing_as_zero(spark):
    df = scores(spark, [(0.5, 0.5, None, 0.0, 0.0, 0.0), (0.9, 0.0, 0.0, 0.0, 0.0, 0.0)])
    assert df.agg(metrics.sum_valid_rate()).first()[0] == 0.5


def test_parse_reply(spark):
    item = '{"id":1,"joy":0.5,"sadness":0.1,"anger":0.1,"fear":0.1,"surprise":0.1,"neutral":0.1}'
    values = [f"[{item}]", f"```json\n[{item}]\n```", f"text [{item}] more", f"[{item},{item}]", "none", None, "[broken"]
    parsed = parsing.parse_score_reply("v", 1)
    assert column(spark, values, F.size(parsed)) == [1, 1, 1, -1, -1, -1, -1] or column(
        spark, values, F.size(parsed)) == [1, 1, 1, None, None, None, None]
    assert column(spark, values[:1], parsed[0]["joy"]) == [0.5]


@pytest.mark.parametrize("sample", ["http://a.b/c", "回复@a:b", "x　y\x1cz", "//@你:好 [x] #t#", "a  b\n"])
def test_clean_text_matches_unicode_regex_rules(spark, sample):
    out = sample
    for pattern in (r"http\S+", r"回复@\S+:", r"//@\S+:", r"\[[^\]]+\]"):
        out = re.sub(pattern, "", out)
    out = re.sub(r"\s+", " ", re.sub(r"#([^#]+)#", r"\1", out)).strip()
    assert column(spark, [sample], text.clean_text("v")) == [out]
