"""Number grammars as column expressions. A strict parser gives (value, error); a lenient one null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import settled, trim

LEAST, MOST = 100, 100_000


def feed_price(c: Column) -> tuple[Column, Column]:
    """Strict price: blank or `-` is null; digits or comma groups, an optional `+` and fraction, rounded half up
    on the first fraction digit; zero is null; the rest lies in LEAST..MOST or is an error."""
    t = trim(c)
    blank = t.isin("", "-")
    shaped = t.rlike(r"^\+?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?$")
    plain = F.regexp_replace(t, r"[+,]", "")
    # only the first fraction digit counts
    n = F.try_add(F.regexp_extract(plain, r"^\d+", 0).try_cast("decimal(38,0)"), F.when(plain.rlike(r"\.[5-9]"), 1).otherwise(0).cast("decimal(38,0)"))
    ok = shaped & n.isNotNull() & ((n == 0) | n.between(LEAST, MOST))
    return F.when(~blank & ok & (n > 0), n.cast("int")), ~blank & ~F.coalesce(ok, F.lit(False))


def lenient_int(c: Column) -> Column:
    """Commas anywhere before the point are ignored, halves round away from zero, what can't be read is null."""
    t = trim(c)
    plain = F.regexp_replace(t, r"[+,]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.$", ""), r"^(-?)\.", "$10.")
    return F.when(t.rlike(r"^[+-]?(?=[^.]*\d|\.\d)[\d,]*(\.\d*)?$"), F.round(plain.try_cast("decimal(38,10)"), 0).try_cast("int"))


def fixed_decimal(c: Column) -> tuple[Column, Column]:
    """Six decimals, exactly: blank or `-` is null; further fraction digits must be zero; else an error."""
    t = trim(c)
    blank = t.isin("", "-")
    shaped = t.rlike(r"^[+-]?,*\d[\d,]*(\.\d{0,6}0*)?$")
    value = F.regexp_replace(F.regexp_replace(t, r"[+,]", ""), r"\.$", "").try_cast("decimal(18,6)")
    ok = shaped & value.isNotNull()
    return F.when(~blank & ok, value), ~blank & ~F.coalesce(ok, F.lit(False))


def scaled_text(c: Column) -> Column:
    """A decimal without trailing zeros."""
    s = c.cast("string")
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def _long_division(numerator: Column, denominator: Column) -> Column:
    """(text, rest) of two whole decimals above zero, below 10 ** 32 and 10 ** 29: 32 digits before and 32 after the point, eight at a time."""
    whole = F.lpad(numerator.cast("decimal(38,0)").cast("string"), 32, "0")
    chunks = F.array(*(F.substring(whole, 8 * k + 1, 8).cast("long") for k in range(4)), *(F.lit(0).cast("long") for _ in range(4)))
    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("rest"), F.lit("").alias("text"))

    def step(state: Column, chunk: Column) -> Column:
        now = (state["rest"] * 10**8 + chunk).cast("decimal(38,0)")
        digits = F.lpad(F.call_function("div", now, denominator).cast("string"), 8, "0")
        return F.struct((now % denominator).cast("decimal(38,0)").alias("rest"), F.concat(state["text"], digits).alias("text"))

    return F.aggregate(chunks, start, step)


def _plain(digits: Column, before: Column) -> Column:
    """Digits with a point after the first `before` of them (zeros are put before or behind), without zeros at the end."""
    n = F.length(digits)
    text = F.when(before <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -before), digits)).when(before >= n, F.concat(digits, F.repeat(F.lit("0"), before - n)))
    text = text.otherwise(F.concat(F.substring(digits, F.lit(1), before), F.lit("."), F.substring(digits, before + 1, n)))
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def with_ratio_text(df: DataFrame, name: str, numerator: Column, denominator: Column) -> DataFrame:
    """df with the text of a quotient of two whole decimals, null if either is: exact if it ends within 32 decimals, else the nearest
    double with 17 significant digits, rounded from its exact value, half to even; never with an exponent. A
    denominator of zero is an error. Each step is a column of its own, as the next ones use it several times."""
    at = lambda c: F.col(f"{c}__")
    zero = F.raise_error(F.lit("the denominator of a ratio is zero")).cast("decimal(38,0)")
    known = numerator.isNotNull() & denominator.isNotNull()
    den = F.when(known & (denominator == 0), zero).otherwise(F.when(known, denominator.cast("decimal(38,0)")))
    d = df.select(F.struct(*df.columns).alias("own__"), F.when(known, numerator.cast("decimal(38,0)")).alias("num__"), den.alias("den__"))
    d = settled(d).withColumn("exact__", F.when(at("num").isNotNull(), _long_division(F.abs(at("num")), F.abs(at("den")))))
    d = settled(d).withColumn("plain__", _plain(F.regexp_replace(at("exact")["text"], "^0{0,31}", ""), 32 - F.length(F.regexp_extract(at("exact")["text"], "^0{0,31}", 0))))
    # the nearest double is m / 2 ** k with whole m below 2 ** 55; k may be below zero
    d = settled(d).withColumn("value__", F.when(at("exact")["rest"] != 0, F.concat(F.substring(at("exact")["text"], 1, 32), F.lit("."), F.substring(at("exact")["text"], 33, 32)).cast("double")))
    d = settled(d.withColumn("k__", 53 - F.floor(F.log2(at("value"))).cast("int")))
    small = F.raise_error(F.lit("a ratio below 2 ** -42 that has no end")).cast("int")
    d = settled(d.withColumn("k__", F.when(at("k") > 95, small).otherwise(at("k"))))
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k).cast("decimal(20,0)")
    two = (power(F.least(F.abs(at("k")), F.lit(48))) * power(F.greatest(F.abs(at("k")) - 48, F.lit(0)))).cast("decimal(38,0)")
    m = (at("value") * F.pow(F.lit(2.0), at("k"))).cast("long").cast("decimal(38,0)")
    d = settled(d.withColumns({"m__": m, "two__": two}))
    one = F.lit(1).cast("decimal(38,0)")
    d = settled(d.withColumns({"m__": F.when(at("k") < 0, (at("m") * at("two")).cast("decimal(38,0)")).otherwise(at("m")), "two__": F.when(at("k") < 0, one).otherwise(at("two"))}))
    d = settled(d.withColumn("exact_double__", F.when(at("m").isNotNull(), _long_division(at("m"), at("two")))))
    text = at("exact_double")["text"]
    d = settled(d.withColumn("lead__", F.length(F.regexp_extract(text, "^0*", 0)))).withColumns({"head__": F.substring(text, at("lead") + 1, F.lit(17)), "tail__": F.substring(text, at("lead") + 18, F.lit(64))})
    half = F.rpad(F.lit("5"), F.length(at("tail")), F.lit("0"))
    odd = F.substring(at("head"), 17, 1).cast("int") % 2 == 1
    up = (at("tail") > half) | ((at("tail") == half) & ((at("exact_double")["rest"] != 0) | odd))
    d = settled(d).withColumn("digits__", (at("head").cast("decimal(38,0)") + up.cast("int")).cast("string"))
    near = _plain(at("digits"), 32 - at("lead") + F.length(at("digits")) - 17)
    sign = F.when((at("num") != 0) & ((at("num") < 0) != (at("den") < 0)), "-").otherwise("")
    return d.select("own__.*", F.concat(sign, F.when(at("value").isNotNull(), near).otherwise(at("plain"))).alias(name))
