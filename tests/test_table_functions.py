"""Table functions and the Lancaster stemmer against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import stemming
from loomtext.functions.similarity import edit_script
from loomtext.operators import table_functions as TF
from loomtext.plans import text

SF = "/root/testdata/sf0.001"


def test_steps_turn_one_text_into_the_other(spark):
    rng = random.Random(61)
    rows = [(k, "".join(rng.choices("abcé", k=rng.randint(0, 8))), "".join(rng.choices("abcé", k=rng.randint(0, 8)))) for k in range(200)] + [(200, None, "a"), (201, "a", None), (202, "", "")]
    got = {}
    for r in TF.edit_steps(spark.createDataFrame(rows, "k int, a string, b string"), "a", "b").orderBy("k", "step").collect():
        got.setdefault(r.k, []).append((r.operation, r.before, r.after))
    assert got == {k: edit_script(a, b) for k, a, b in rows if a is not None and b is not None and (a or b)}
    for k, steps in got.items():
        assert "".join(x for _, x, _ in steps) == rows[k][1] and "".join(y for _, _, y in steps) == rows[k][2]


def test_runs_of_partitions(spark):
    rng = random.Random(62)
    rows = [(rng.choice(["x", "y", None]), k, rng.choice([None, 1.0, 2.0, 3.0])) for k in range(300)]
    got = sorted(map(tuple, TF.rising_runs(spark.createDataFrame(rows, "p string, k long, v double").repartition(7), F.col("p"), F.col("k"), F.col("v")).collect()), key=str)
    expected = []
    for part in ("x", "y", None):
        runs = []
        before = None
        for _, k, v in (r for r in rows if r[0] == part):
            if runs and v is not None and before is not None and v >= before:
                runs[-1].append(k)
            else:
                runs.append([k])
            before = v
        expected += [(part, n, r[0], r[-1], len(r)) for n, r in enumerate(runs, 1)]
    assert got == sorted(expected, key=str)


def test_functions_of_sql(spark):
    TF.register(spark)
    spark.read.parquet(f"{SF}/part.parquet").createOrReplaceTempView("loom_part")
    rows = spark.sql("SELECT p.p_partkey, s.* FROM loom_part p, LATERAL edit_steps(p.p_name, upper(p.p_name)) s").collect()
    names = {r.p_partkey: r.p_name for r in spark.table("loom_part").collect()}
    assert len(rows) == sum(map(len, names.values()))
    runs = spark.sql("SELECT * FROM runs(TABLE(SELECT p_brand AS part, p_partkey AS key, p_retailprice AS value FROM loom_part) PARTITION BY part ORDER BY key)")
    assert runs.agg(F.sum("rows")).first()[0] == len(names)


@pytest.mark.parametrize(("word", "stem"), [line.split() for line in ("maximum maxim", "presumably presum", "multiply multiply", "provision provid", "owed ow", "ear ear", "saying say", "crying cry", "string string", "meant meant", "cement cem", "destabilize dest", "misunderstanding misunderstand", "friendship friend", "football footbal", "RAILROAD railroad", "a a", "x1 x1", "żeńskie żeńsky")])
def test_lancaster_stems(word, stem):
    assert stemming.lancaster(word) == stem


def test_lancaster_table(spark):
    words = {r.w for r in text._vocabulary(spark, SF).collect()}
    got = {r.w: (r.porter, r.lancaster) for r in text.lancaster_table(spark, SF).collect()}
    assert got == {w: (p, c) for w in words if (p := stemming.porter(w)) != (c := stemming.lancaster(w))}
    assert 0.2 < len(got) / len(words) < 0.9
