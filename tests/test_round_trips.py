"""Files written and read again, heads, and the variants' counts against plain Python."""

import collections

import regex
from pyspark.sql import functions as F

from loomtext.functions import stemming, text as X
from loomtext.plans import catalogue, search, text
from loomtext.sources import files

SF = "/root/testdata/sf0.001"


def test_csv_keeps_texts_and_nulls(spark, tmp_path):
    rows = [(1, "a;b", None), (2, 'say "x"', 1.5), (3, "ż\nnext", -2.0), (4, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, name string, price double")
    files.write_csv(df.where("id <> 3"), str(tmp_path / "c"), ";")
    got = sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema, ";").collect()))
    assert got == [rows[0], rows[1], rows[3]]


def test_json_lines_with_gzip(spark, tmp_path):
    rows = [(1, "ż\n", None), (2, None, 1.5)]
    df = spark.createDataFrame(rows, "id long, name string, price double")
    files.write_json(df, str(tmp_path / "j"), "gzip")
    read = files.read_jsonl(spark, str(tmp_path / "j"), df.schema, 3)
    assert sorted(map(tuple, read.collect())) == rows and read.rdd.getNumPartitions() == 3
    assert any(p.name.endswith(".gz") for p in (tmp_path / "j").iterdir())


def test_round_trips_of_tables(spark):
    for query, name, columns in ((catalogue.csv_round_trip, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]), (catalogue.json_lines_round_trip, "events", ["event_id", "user_id", "event_type", "value"])):
        given = spark.read.parquet(f"{SF}/{name}.parquet").select(columns)
        got = query(spark, SF).select(columns)
        assert got.count() == given.count() and got.exceptAll(given).isEmpty()


def test_head_follows_files_and_places(spark, tmp_path):
    spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    got = [r.id for r in files.head(spark.read.parquet(str(tmp_path / "t")), 37).collect()]
    assert got == list(range(37))


def test_facets_agree(spark):
    rows = search.facets_agree(spark, SF).collect()
    assert rows and all(r.equal and r.found == r.scanned for r in rows)


def test_four_variants(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = [w for t in texts for w in regex.sub(r"\s+", " ", regex.sub(r"[^\p{L}\p{N}_\s]", "", t).lower()).split(" ") if w]
    stem = {w: stemming.snowball_english(w) for w in set(words)}
    units = {"words": words, "stems": [stem[w] for w in words], "no stop words": [w for w in words if w not in X.STOP_WORDS]}
    got = {r.variant: (r.units, r.vocabulary) for r in text.four_variants(spark, SF).collect()}
    assert {k: got[k] for k in units} == {k: (len(v), len(set(v))) for k, v in units.items()}
    assert got["byte units"][0] == text.byte_level_units(spark, SF).agg(F.sum("units")).first()[0]
    assert collections.Counter(got) and got["byte units"][1] <= 1256
