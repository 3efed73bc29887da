"""Known values of cleaning and of string measures, and near pairs against all pairs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import cleaning as C, similarity as S, text as X
from loomtext.operators import tokens as T


def values(spark, column, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


CASES = {
    C.normalise: {"  Dell  ": "Dell", "Brak danych": None, " - ": None, "a \t b\n c": "a b c", "": None, "Brak  x": "Brak x"},
    C.decimal_number: {"4.7/5.0 ⭐": 4.7, "4.7 / 5.0 ⭐": 4.7, "3.2": 3.2, "Brak oceny": None, "Brak ocen": None, "-": None, "1.75 kg": 1.75},
    C.whole_number: {"142 opinii": 142, "0 opinii": 0, "1 200 opinii": 1200, "1 200 opinii": 1200},
    C.weight_kg: {"1.75 kg": 1.75, "1,43 kg": 1.43, "lekki": None},
    C.yes_no: {"Tak": True, " nie ": False, "może": None},
    C.slug: {"Może -- żółć 1!": "moze-zolc-1"},
    C.polish_date: {"2026-04-03": "03.04.2026", "dzisiaj": "dzisiaj"},
    C.price: {"1 201,35 zł": (1201.35, "PLN"), "7 726,24 zł": (7726.24, "PLN"), "99,00 zł": (99.0, "PLN"), "799,00 EUR": (799.0, "EUR"), "$649.99": (649.99, "USD"), "$1 234.56": (1234.56, "USD"), "$1,234.56": (1234.56, "USD"), "1.234,56 €": (1234.56, "EUR"), "": (None, None)},
    C.price_in_pln: {"1 299,00 zł": (1299.0, "PLN", 1299.0), "100,00 €": (100.0, "EUR", 430.0), "$250.00": (250.0, "USD", 1000.0), "3 499,99 zł": (3499.99, "PLN", 3499.99), "": (None, None, None)},
    C.warranty: {"24 miesiące": ("24 miesiące", 24), "12 miesięcy": ("12 miesięcy", 12), "Dożywotnia producenta": ("Dożywotnia producenta", None), "Brak informacji": (None, None), "-": (None, None), "2 lata": ("2 lata", 24), "Zgodnie z rękojmią": ("Zgodnie z rękojmią", 24)},
    C.warranty_months: {"24 miesiące": (24, "24 mies."), "brak informacji": (None, "brak informacji"), "-": (None, "-")},
}


@pytest.mark.parametrize("column", CASES, ids=lambda f: f.__name__)
def test_cleaning(spark, column):
    cases = CASES[column]
    got = [tuple(x) if isinstance(x, tuple) else x for x in values(spark, column, [*cases, None])]
    assert got[:-1] == list(cases.values())
    last = got[-1]
    assert last is None or all(x is None or x == "brak informacji" for x in last)


def test_dates(spark):
    today = F.lit("2026-10-07").cast("date")
    day = datetime.date
    cases = {"2026-04-03": day(2026, 4, 3), "03.04.2026": day(2026, 4, 3), "03/04/2026": day(2026, 4, 3), "dzisiaj": day(2026, 10, 7), "wczoraj": day(2026, 10, 6), "przedwczoraj": day(2026, 10, 5), "3 dni temu": day(2026, 10, 4), "kiedyś": None, None: None}
    assert values(spark, lambda c: C.any_date(c, today), list(cases)) == list(cases.values())


PAIRS = [("Ala ma kota", "Ala posiada kota", 6, 6, 0.1532, 0.4118, 0.6250), ("kot", "kto", 2, 1, 0.4444, 0.0, 0.3333), ("Kraków", "Krakow", 1, 1, 0.0667, 0.2857, 0.8333), ("profesor", "proffesor", 1, 1, 0.0222, 0.1111, 0.8889), ("kot w butach", "butach w kot", 10, 10, 0.3889, 0.0, 0.1667)]


def test_string_measures(spark):
    a, b = F.col("a"), F.col("b")
    rows = spark.createDataFrame([(k, *p[:2]) for k, p in enumerate(PAIRS)], "i int, a string, b string").orderBy("i")
    got = rows.select(F.levenshtein(a, b), S.damerau_column()(a, b), F.round(1 - S.jaro_winkler_column()(a, b), 4), F.round(1 - X.multiset_jaccard(X.characters(a), X.characters(b)), 4), F.round(X.normalised_levenshtein(a, b), 4)).collect()
    assert [tuple(r) for r in got] == [p[2:] for p in PAIRS]
    assert S.jaro("blue gear", "old gear") == pytest.approx(0.75)  # three letters out of order are one transposition
    steps = S.edit_script(*PAIRS[0][:2])
    assert [sum(o == k for o, _, _ in steps) for k in ("insert", "substitute", "delete", "match")] == [5, 1, 0, 10]


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(81)
    names = sorted({"".join(rng.choices("abé", k=rng.randint(0, 7))) for _ in range(120)})
    for edits in (0, 1, 2):
        got = sorted((r.a, r.b, r.distance) for r in T.near_pairs(spark.createDataFrame([(n,) for n in [*names, None, "ab"]], "n string"), "n", edits).collect())
        assert got == [(a, b, d) for a in names for b in names if a < b and (d := S._distances(a, b)[-1][-1]) <= edits]
