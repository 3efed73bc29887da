"""Column functions that clean messy catalogue text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Texts by which a catalogue says "no value" (fixed values).
MISSING = ("", "-", "—", "brak", "brak oceny", "brak ocen", "brak informacji", "brak danych", "none", "null")
#: Currency signs in the order in which they are looked for (fixed values).
CURRENCIES = (("zł", "PLN"), ("pln", "PLN"), ("eur", "EUR"), ("€", "EUR"), ("$", "USD"), ("usd", "USD"))
#: Rates to PLN (fixed values).
RATES = {"PLN": 1.0, "EUR": 4.30, "USD": 4.00}
#: Warranty texts without a number, and their months (fixed values).
WARRANTIES = {"zgodnie z rękojmią": 24}
#: Patterns of numbers, months and relative days (fixed values).
NUMBER, WHOLE, PERIOD, AGO = r"\d+(?:[.,]\d+)?", r"\d[\d ]*", r"(\d+)\s*(mies|lat|rok)", r"^(\d+)\s+dni\s+temu$"
#: Days before today of relative dates (fixed values).
DAYS_AGO = {"dzisiaj": 0, "dziś": 0, "wczoraj": 1, "przedwczoraj": 2}


def normalise(c: Column) -> Column:
    """White space collapsed, no-break spaces too; texts for "no value" are null."""
    x = F.trim(F.regexp_replace(F.replace(c.cast("string"), F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))
    return F.when(~F.lower(x).isin(*MISSING), x)


def first_match(c: Column, pattern: str) -> Column:
    """The first match of a pattern, or null."""
    x = F.regexp_extract(c, f"({pattern})", 1)
    return F.when(x != "", x)


def price(c: Column) -> Column:
    """struct(amount, currency): the last separator is the decimal one if both
    occur, a lone comma is decimal; the currency is the first sign found."""
    x = normalise(c)
    low = F.lower(x)
    currency = F.coalesce(*(F.when(F.contains(low, F.lit(sign)), F.lit(code)) for sign, code in CURRENCIES))
    digits = F.regexp_replace(x, r"[^\d,.]", "")
    comma, dot = F.instr(F.reverse(digits), ","), F.instr(F.reverse(digits), ".")
    both = (comma > 0) & (dot > 0)
    plain = (
        F.when(both & (comma < dot), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(digits, F.lit(","), F.lit("")))
        .otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    )
    return F.struct(plain.try_cast("double").alias("amount"), currency.alias("currency"))


def price_in_pln(c: Column) -> Column:
    """struct(amount, currency, pln): a leading $ is USD, any € is EUR, all else
    PLN; USD drops commas, the others read them as decimal. Two dots: no amount."""
    x = F.trim(F.replace(c.cast("string"), F.lit("\u00a0"), F.lit(" ")))
    code = F.when(F.startswith(x, F.lit("$")), F.lit("USD")).when(F.contains(x, F.lit("€")), F.lit("EUR")).otherwise(F.lit("PLN"))
    digits = F.regexp_replace(x, r"[^\d,.]", "")
    amount = F.round(F.replace(digits, F.lit(","), F.when(code == "USD", F.lit("")).otherwise(F.lit("."))).try_cast("double"), 2)
    rate = F.create_map(*(F.lit(v) for kv in RATES.items() for v in kv))[code]
    some = c.isNotNull() & (c != "")
    return F.struct(F.when(some, amount).alias("amount"), F.when(some, code).alias("currency"), F.when(some, F.round(amount * rate, 2)).alias("pln"))


def decimal_number(c: Column) -> Column:
    """The first number with an optional fraction (ratings, weights)."""
    return F.replace(first_match(normalise(c), NUMBER), F.lit(","), F.lit(".")).try_cast("double")


def weight_kg(c: Column) -> Column:
    """A weight text without its unit, rounded to grams; null if it isn't a number."""
    return F.round(F.trim(F.replace(F.replace(c, F.lit("kg"), F.lit("")), F.lit(","), F.lit("."))).try_cast("double"), 3)


def whole_number(c: Column) -> Column:
    """The first whole number; spaces between digits are dropped."""
    return F.replace(first_match(normalise(c), WHOLE), F.lit(" "), F.lit("")).try_cast("long")


def warranty(c: Column) -> Column:
    """struct(text, months): months as such, years times 12, else null."""
    x = normalise(c)
    low = F.lower(x)
    number = F.regexp_extract(low, PERIOD, 1).try_cast("long")
    unit = F.regexp_extract(low, PERIOD, 2)
    fixed = F.create_map(*(F.lit(v) for kv in WARRANTIES.items() for v in kv))[low]
    months = F.coalesce(fixed.cast("long"), F.when(unit.isin("lat", "rok"), number * 12).otherwise(number))
    return F.struct(x.alias("text"), months.alias("months"))


def warranty_months(c: Column) -> Column:
    """struct(months, text) of a warranty: its first whole number."""
    none = c.isNull() | c.isin("", "—", "brak informacji")
    months = F.regexp_extract(c, r"(\d+)", 1).try_cast("long")
    text = F.when(none, "brak informacji").when(months.isNotNull(), F.concat(months.cast("string"), F.lit(" mies."))).otherwise(F.trim(c))
    return F.struct(F.when(~none, months).alias("months"), text.alias("text"))


def any_date(c: Column, today: Column) -> Column:
    """A date in one of three formats or relative to ``today``; else null."""
    x = normalise(c)
    low = F.lower(x)
    days = F.coalesce(F.create_map(*(F.lit(v) for kv in DAYS_AGO.items() for v in kv))[low], F.regexp_extract(low, AGO, 1).try_cast("int"))
    return F.coalesce(F.date_sub(today, days), *(F.try_to_date(x, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")))


def polish_date(c: Column) -> Column:
    """An ISO date as DD.MM.YYYY; any other text as it is."""
    return F.regexp_replace(F.trim(c), r"^(\d{4})-(\d{2})-(\d{2})$", "$3.$2.$1")


def yes_no(c: Column) -> Column:
    """tak/nie as a boolean."""
    return F.create_map(F.lit("tak"), F.lit(True), F.lit("nie"), F.lit(False))[F.lower(normalise(c))]


def slug(c: Column) -> Column:
    """Polish letters folded, other characters as single inner hyphens."""
    x = F.translate(F.lower(c), "ąćęłńóśźż", "acelnoszz")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def html_escape(c: Column) -> Column:
    """The five characters that HTML reserves, & first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def stars(c: Column) -> Column:
    """A rating as five stars."""
    n = F.least(F.greatest(F.round(c).cast("int"), F.lit(0)), F.lit(5))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def flat_map(c: Column) -> Column:
    """A map as "k: v | k: v"."""
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def convert(amount: Column, currency: Column, rates: dict[str, float] = RATES) -> Column:
    """Amount times the currency's rate, rounded to 2; unknown currencies are null."""
    return F.round(amount * F.create_map(*(F.lit(v) for kv in rates.items() for v in kv))[currency], 2)
