import hashlib
import json

import pytest
from pyspark.sql import functions as F

from feltgrid.operators import enrich
from feltgrid.plans import build
from feltgrid.sources import manifest, posts, tables

LONG = "今天天气真的非常好我们一起去公园玩"


@pytest.fixture()
def raw_folder(tmp_path):
    january = (
        "﻿_id,user_id,created_at,content\n"
        f'p1,u1,2020-01-06 10:00:00,"{LONG}\n第二行"\n'
        f'p2,u2,2020-01-07,"他说""好""{LONG}"\n'
        f"p3,u9,2020-01-08,{LONG}\n"
        f"p4, ,2020-01-09,{LONG}\n"
        "p5,u1,not a date,abc\n"
        "p6,u1,2020-01-10,短\n"
    )
    (tmp_path / "2020-01.csv").write_text(january, encoding="utf-8")
    folder = tmp_path / "2020-02"
    folder.mkdir()
    for i in range(2):
        (folder / f"part-{i}.csv").write_text(f"_id,user_id,created_at,content\nq{i},u1,2020-02-0{i + 1},{LONG}\n", encoding="utf-8")
    users = "﻿user_id,province,city,gender\nu1, 北京 ,海淀,f\nu1,上海,,m\nu2,海外,,\nu3,广东,广州,m\n"
    (tmp_path / "user.csv").write_text(users, encoding="utf-8")
    return str(tmp_path)


def test_read_posts(spark, raw_folder):
    df = posts.read_posts(spark, raw_folder, ["2020-01", "2020-02", "2020-03"])
    rows = {r["_id"]: r for r in df.collect()}
    assert len(rows) == 8
    assert rows["p1"].content == LONG + "\n第二行"
    assert rows["p2"].content == f'他说"好"{LONG}'
    assert rows["p1"].file_month == "2020-01" and rows["q1"].file_month == "2020-02"
    assert df.schema["geo_info"].dataType.simpleString() == "string"
    missing = posts.missing_months(spark, raw_folder, ["2020-01", "2020-02", "2020-03"]).collect()
    assert [(r.month, r.issue) for r in missing] == [("2020-03", "MISSING: 2020-03.csv")]
    with pytest.raises(FileNotFoundError):
        posts.read_posts(spark, raw_folder, ["2019-12"])


def test_read_users_first_row_wins(spark, raw_folder):
    users = posts.read_users(spark, raw_folder + "/user.csv")
    assert sorted((r.user_id, r.province, r.city) for r in users.collect()) == [("u1", "北京", "海淀"), ("u3", "广东", "广州")]


def test_mini_dataset(spark, raw_folder):
    df = posts.read_posts(spark, raw_folder, ["2020-01", "2020-02"])
    users = posts.read_users(spark, raw_folder + "/user.csv")
    kept, log = build.mini_dataset(df, users, {"2020-01": 10, "2020-02": 1})
    rows = kept.collect()
    assert {r.post_id for r in rows if r.post_id.startswith("p")} == {"p1"}
    assert len([r for r in rows if r.post_id.startswith("q")]) == 1
    assert rows[0].province == "北京"
    assert {r.reject_reason: r["count"] for r in log.collect()} == {"unknown_province": 3, "bad_date": 1, "too_short": 1}
    national, _ = build.mini_dataset(df, users, {"2020-01": 10}, keep_unknown=True)
    assert {r.post_id for r in national.collect()} == {"p1", "p2", "p3", "p4"}


def test_first_rows_follow_file_names_not_sizes(spark, tmp_path):
    month = tmp_path / "2020-01"
    month.mkdir()
    (month / "part-0.csv").write_text("_id,user_id\n" + "".join(f"a{i},u1\n" for i in range(3)), encoding="utf-8")
    (month / "part-1.csv").write_text("_id,user_id\n" + "".join(f"b{i},u1\n" for i in range(30_000)), encoding="utf-8")
    df = posts.read_csv(spark, str(month), position="position").withColumn("file_month", F.lit("2020-01"))
    first = enrich.first_rows_per_month(df, ["2020-01"], 5)
    assert sorted(r["_id"] for r in first.collect()) == ["a0", "a1", "a2", "b0", "b1"]
    users = tmp_path / "users"
    users.mkdir()
    (users / "part-0.csv").write_text("user_id,province,city,gender\nu1,北京,first,f\n", encoding="utf-8")
    rest = "".join(f"u{i},北京,later,f\n" for i in range(5_000))
    (users / "part-1.csv").write_text("user_id,province,city,gender\n" + rest, encoding="utf-8")
    assert {r.city for r in posts.read_users(spark, str(users)).filter("user_id = 'u1'").collect()} == {"first"}


def test_first_rows_and_quality_profile(spark, raw_folder):
    df = posts.read_posts(spark, raw_folder, ["2020-01", "2020-02"])
    first = enrich.first_rows_per_month(df, ["2020-01", "2020-02"], 2)
    assert sorted(r["_id"] for r in first.collect()) == ["p1", "p2", "q0", "q1"]
    profile = {r.file_month: r for r in enrich.quality_profile(df).collect()}
    january = profile["2020-01"]
    assert january.sampled == 6
    assert january.created_at_parse_rate == pytest.approx(5 / 6)
    assert january.user_id_non_null_rate == pytest.approx(5 / 6)
    assert january.geo_info_non_null_rate == 0


def test_benchmark_json_and_tsv(spark, tmp_path):
    items = [{"id": "1", "content": "好", "label": "happy"}, {"id": "2", "content": "坏", "label": "angry"}]
    (tmp_path / "a.txt").write_text(json.dumps(items, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.txt").write_text("id\tcontent\tlabel\n1\t好\thappy\n2\t坏\tangry\n", encoding="utf-8")
    for name in ("a.txt", "b.txt"):
        rows = posts.read_benchmark(spark, str(tmp_path / name)).collect()
        assert sorted((r.id, r.content, r.label) for r in rows) == [("1", "好", "happy"), ("2", "坏", "angry")]


def test_schema_checks(spark):
    df = spark.createDataFrame([(1,)], "post_id int")
    assert [r.issue for r in tables.schema_issues(df, ["post_id", "joy"], "labels").collect()] == ["labels missing column: joy"]
    with pytest.raises(ValueError, match="joy"):
        tables.require_columns(df, ["joy"])


def test_existing_ids_reads_one_column(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.range(3).select(F.col("id").alias("post_id"), F.lit("x").alias("content")).write.parquet(path)
    ids = tables.existing_ids(spark, path)
    assert sorted(r.post_id for r in ids.collect()) == ["0", "1", "2"]
    assert "content" not in ids._jdf.queryExecution().executedPlan().toString()


def test_coercion(spark):
    df = spark.createDataFrame(
        [("1.5", "True", " joy", "北京市", "3.9"), ("x", "no", "rage", None, ""), (None, " ", "", None, None), ("1e3abc", "TRUE", None, "b", "-2")],
        "` n ` string, flag string, e string, p string, i string")
    out = tables.coerce_table(df, ["n"], ["flag"], ["e"], ["p"], ["i"]).collect()
    assert [(r.n, r.flag, r.e, r.p, r.i) for r in out] == [
        (1.5, True, "joy", "北京", 3), (0.0, False, "neutral", "", 0), (1000.0, True, "neutral", "b", -2)]


def test_stop_words(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("# comment\n新词\n\n 的 \n", encoding="utf-8")
    words = {r.word for r in tables.stop_words(spark, str(path)).collect()}
    assert "新词" in words and "的" in words and "# comment" not in words


def test_manifest(spark, tmp_path):
    for name, content in {
        "cluster_labels/a.csv": "x,y\n1,2\n3,4\n", "anomaly_detection/b.json": '[{"a":1},{"a":2},{"a":3}]',
        "nlp_keywords_by_week/c.json": '{"meta":{},"weeks":{"w1":1,"w2":2}}',
        "nlp_global_vocabulary/d.json": '{"vocabulary":[1,2,3,4]}', "lines/e.json": '{"a":1}\n{"a":2}\n', "empty/f.csv": "x,y\n",
    }.items():
        target = tmp_path / name
        target.parent.mkdir()
        target.write_text(content)
    rows = {r.path: r for r in manifest.manifest(spark, str(tmp_path)).collect()}
    assert {p: r.row_count for p, r in rows.items()} == {
        "cluster_labels/a.csv": 2, "anomaly_detection/b.json": 3, "nlp_keywords_by_week/c.json": 2,
        "nlp_global_vocabulary/d.json": 4, "lines/e.json": 2, "empty/f.csv": 0}
    assert rows["cluster_labels/a.csv"].hash == hashlib.sha256(b"x,y\n1,2\n3,4\n").hexdigest()[:12]
    assert rows["cluster_labels/a.csv"].size_bytes == 12
    status = manifest.bundle_status(manifest.manifest(spark, str(tmp_path)), ["cluster_labels", "other"], ["nlp_keywords_by_week"]).first()
    assert status.errors == ["MISSING: other"] and status.nlp_keywords_available


def test_export_and_summary(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    manifest.export_bundle({"cluster_labels": df}, str(tmp_path), {"cluster_labels": "csv"})
    assert sum(r.row_count for r in manifest.manifest(spark, str(tmp_path)).collect()) == 2
    tables.write_panel(df, str(tmp_path / "by"), partition_by=["n"])
    assert spark.read.parquet(str(tmp_path / "by")).filter("n = 1").count() == 1
    assert json.loads(tables.run_summary(df.agg(F.count("*").alias("rows")))) == {"rows": 2}


def test_csv_cut_at_every_byte(spark, tmp_path):
    """One file read by many tasks, whatever falls on a cut."""
    rows = [("1", "plain", "x"), ("2", "two\nlines", ""), ("3", 'a ""quoted"" word', "é\r\nü"), ("4", "\n\n\n", "end, comma"), ("5", "long " * 30 + "\n" + "tail " * 20, "日本\n語")]
    rows = [(f"{i}-{a}", b.replace('""', '"'), c) for i in range(4) for a, b, c in rows]
    quoted = lambda t: '"' + t.replace('"', '""') + '"' if any(c in t for c in ',"\n\r') else t
    content = "﻿id,content,note\n" + "".join(",".join(map(quoted, r)) + "\n" + ("\n" if i % 7 == 3 else "") for i, r in enumerate(rows))
    (tmp_path / "a.csv").write_bytes(content.encode())
    (tmp_path / "b.csv").write_bytes(b'id,content,note\r\n9,"last\r\nrow",z')
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (16, 37, 100, 1001, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            df = posts.read_csv(spark, str(tmp_path), position="place", path="file")
            assert df.columns == ["id", "content", "note", "place", "file"]
            found = df.orderBy("place").collect()
            want = [*((a, b, c or None) for a, b, c in rows), ("9", "last\r\nrow", "z")]
            assert [tuple(r)[:3] for r in found] == want, size
            assert len({r.place for r in found}) == len(found) and {r.file[-5:] for r in found} == {"a.csv", "b.csv"}
            if size == 100:
                from feltgrid.sources.splitcsv import range_parities, read_lines
                ranges, cut = range_parities(read_lines(spark, [str(tmp_path)]))
                assert sum(map(len, ranges.values())) > 10 and cut
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)


def test_writers_describe_their_files(spark, tmp_path):
    df = spark.range(0, 100, 1, 5).select("id", F.concat(F.lit('a "b", c\n'), "id").alias("text"), F.when(F.col("id") > 50, 1.5).alias("x"))
    for _ in range(2):  # the second export replaces the first
        manifest.export_bundle({"t": df, "lines": df, "none": df.filter("id < 0")}, str(tmp_path), {"lines": "json"})
    (tmp_path / "t" / "part-lost.csv").write_text("left by a lost attempt")
    entries = manifest.manifest(spark, str(tmp_path)).collect()
    for e in entries:
        data = (tmp_path / e.path).read_bytes()
        assert e.hash == hashlib.sha256(data).hexdigest()[:12] and e.size_bytes == len(data) and e.path.startswith(f"{e.source}/")
    total = {s: (sum(e.row_count for e in entries if e.source == s), sum(e.source == s for e in entries)) for s in ("t", "lines", "none")}
    assert total["t"] == total["lines"] == (100, 5) and total["none"] == (0, 1)
    files = sorted(str(tmp_path / e.path) for e in entries if e.source == "t")
    back = posts.read_csv(spark, files)
    assert sorted((r.id, r.text, r.x) for r in back.collect()) == sorted((str(i), f'a "b", c\n{i}', "1.5" if i > 50 else None) for i in range(100))
    rows = [json.loads(line) for e in entries if e.source == "lines" for line in (tmp_path / e.path).read_text().splitlines()]
    assert len(rows) == 100 and rows[0].keys() == {"id", "text", "x"}
