from pyspark.sql import functions as F

from truthmill.operators import pages
from truthmill.sources import readers, writers


def test_news_json_with_and_without_schema(spark, tmp_path):
    path = tmp_path / "news.json"
    path.write_text('{"content": "а", "category": "x"}\n{"content": null}\n', encoding="utf-8")
    inferred = readers.read_news_json(spark, str(path), view="news_view")
    assert inferred.columns == ["category", "content"]
    assert spark.sql("SELECT count(*) FROM news_view").first()[0] == 2
    given = readers.read_news_json(spark, str(path), "content string")
    assert [r.content for r in given.collect()] == ["а", None]


def test_scored_words(spark, tmp_path):
    path = tmp_path / "positive.txt"
    path.write_text("добър,1.5\nлош,-1\nдобър,9\n", encoding="utf-8")
    words = readers.read_scored_words(spark, str(path))
    assert sorted(map(tuple, words.collect())) == [("добър", 1.5), ("лош", -1.0)]
    path2 = tmp_path / "bad.txt"
    path2.write_text("a,1\nb,x\nc\n", encoding="utf-8")
    assert readers.read_scored_words(spark, str(path2)).count() == 0
    assert readers.read_scored_words(spark, str(path2), "skip").collect()[0].word == "a"
    assert readers.read_scored_words(spark, str(tmp_path / "none.txt")).count() == 0


def test_word_list(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("на\nи\n\nна\n", encoding="utf-8")
    assert readers.read_word_list(spark, str(path)) == ["на", "и"]


def test_repair_keeps_objects_and_counts_the_rest(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text('{"a": 1}\n{"a": \nnonsense\n[1]\n{"b": "{"}\n', encoding="utf-8")
    flagged = readers.repair_json_lines(spark.read.text(str(path)))
    assert flagged.filter(~F.col("parses")).count() == 3
    writers.write_repaired(flagged, str(path))
    assert sorted(r.value for r in spark.read.text(f"{path}-new").collect()) == ['{"a": 1}', '{"b": "{"}']


def test_spread_leaves_large_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert readers.spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores * 2)
    assert readers.spread(wide, "id") is wide


def test_writers(spark, tmp_path):
    from truthmill.functions.credibility import FEATURES

    counts = spark.createDataFrame([("дом", 12), ("път", 30)], "word string, cnt long")
    writers.write_word_counts(counts, str(tmp_path / "counts"), single_file=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "counts")).collect()) == ["дом,12", "път,30"]

    row = spark.range(1).select(F.lit(1.0).alias("label"), *[F.lit(0.5).alias(f) for f in FEATURES])
    writers.write_feature_csv(row, str(tmp_path / "features"), single_file=True)
    assert spark.read.csv(str(tmp_path / "features"), header=True).columns == ["label", *FEATURES]

    report = spark.createDataFrame([("train", "f1", None, 0.5)], "dataset string, metric string, label double, value double")
    for fresh in (True, False, True, False):
        writers.write_report(report, str(tmp_path / "report"), fresh=fresh)
    assert spark.read.csv(str(tmp_path / "report"), sep="\t", header=True).count() == 2

    page = spark.createDataFrame([(1, "http://a.bg/x", "<article>b</article>")], "page_id long, url string, html string")
    lines = pages.record_json(pages.extract_records(page)).select(F.from_json("json", "key string, content string").alias("r"))
    writers.write_json_lines(lines.select("r.*"), str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).first().content == "b"


def test_lines_are_routed_by_one_write(spark, tmp_path):
    lines = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("[1]",), ('{"b": "é"}',), ('{"a": 1}',), (None,)], "value string")
    kept, skipped = readers.route_json_lines(lines, str(tmp_path / "routed"))
    assert sorted(r.value for r in kept.collect()) == ['{"a": 1}', '{"a": 1}', '{"b": "é"}']
    assert sorted(r.value for r in skipped.collect()) == ["[1]", '{"a": ']
    assert "PartitionFilters" in kept._jdf.queryExecution().executedPlan().toString()


def test_counts_come_with_the_write(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    side = writers.own_session(spark)
    assert side.conf.get("spark.sql.shuffle.partitions") == "7" and side.conf.get("spark.checkpoint.dir") == spark.conf.get("spark.checkpoint.dir")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = side.range(100)
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        made.add(1)
        return x

    counts = writers.write_counted(rows.select(seen("id").alias("id")), str(tmp_path / "rows"), even=F.col("id") % 2 == 0, small=F.col("id") < 7)
    assert counts == {"even": 50, "small": 7}
    assert made.value == 100  # every row was made once
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 100
    assert writers.write_counted(rows.limit(0), str(tmp_path / "none"), any=F.lit(True)) == {"any": 0}
