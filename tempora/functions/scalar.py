"""Column functions of the event-graph model; all but the two marked ones are JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_if_zero(ts: Column) -> Column:
    """A timestamp of 0 counts as missing."""
    return F.nullif(ts, F.lit(0).cast("double"))


def nan_if_missing(ts: Column) -> Column:
    """For export to tensors, where missing is NaN."""
    return F.coalesce(ts, F.lit(float("nan")))


def eligible(event_ts: Column, obs_ts: Column, sample_obs_ts: Column, zero_is_missing: bool = True) -> Column:
    """Whether an event takes part in causal edges: it has a time that the sample's observation can know."""
    ts = missing_if_zero(event_ts) if zero_is_missing else event_ts
    return F.coalesce(ts.isNotNull() & (obs_ts.isNull() | (event_ts < sample_obs_ts)), F.lit(False))


def edge_feature(diff: Column) -> Column:
    """log(1 + time difference) as float; missing is 0."""
    return F.coalesce(F.nanvl(F.log1p(diff), F.lit(0.0)), F.lit(0.0)).cast("float")


def survival_lower(arrival: Column, censor_time: Column, censor_ts: Column) -> Column:
    return F.when(censor_ts.isNotNull(), censor_time).otherwise(arrival)


def survival_upper(arrival: Column, censor_ts: Column) -> Column:
    return F.when(censor_ts.isNotNull(), F.lit(float("inf"))).otherwise(arrival)


def timestamp_text(text: Column) -> Column:
    """ISO text to a plain one: every T becomes a space, milliseconds are the last digits kept."""
    return F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 23)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands in the body."""
    return F.transform(F.array(value), body)[0]


def half_even(value: Column, digits: int) -> Column:
    """A double rounded to ``digits`` places by its exact binary value; exact halves go to the even digit.

    Only where the shortest decimal text ends in a 5 one place further is that text no guide: there the
    binary fraction decides, taken apart into three pieces of 27 bits.
    """
    if digits < 0:
        return F.bround(value, digits)

    def rounded(x: Column) -> Column:
        size = F.abs(x)
        text = size.cast("decimal(38,17)")
        scaled_ = text * F.lit(10**digits).cast(f"decimal({digits + 1},0)")
        half = (scaled_ - F.floor(scaled_)) == F.lit("0.5").cast("decimal(2,1)")
        whole = F.floor(size)
        fraction = size - whole
        first = F.floor(fraction * 2.0**27)
        second = F.floor((fraction * 2.0**27 - first) * 2.0**27)
        third = (fraction * 2.0**27 - first) * 2.0**27 - second
        bits = (first * (1 << 27) + second).cast("decimal(17,0)")
        # fraction and text's fraction, both times 10**(digits + 1) * 2**54
        ten = F.lit(10 ** (digits + 1)).cast(f"decimal({digits + 2},0)")
        exact = bits * ten
        shown = ((text - whole.cast("decimal(20,0)")) * ten).cast("decimal(20,0)") * F.lit(1 << 54).cast("decimal(17,0)")
        low = (F.floor(scaled_) / F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast("double")
        high = ((F.floor(scaled_) + 1) / F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast("double")
        tie = F.when((exact == shown) & (third == 0), F.bround(size, digits)).when(exact < shown, low).otherwise(high)
        return F.when(half, F.when(x < 0, -tie).otherwise(tie)).otherwise(F.bround(x, digits))

    plain = F.abs(value) < 1e15
    return F.when(plain & F.lit(digits <= 12), bound(F.when(plain, value), rounded)).otherwise(F.when(F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(F.bround(value, digits)))


def json_round(value: Column, digits: int, kind: T.DataType) -> Column:
    """Rounding of doubles by their exact value inside arrays, maps and structs; everything else passes."""
    if isinstance(kind, T.DoubleType):
        return half_even(value, digits)
    if isinstance(kind, T.FloatType | T.DecimalType):
        return F.bround(value, digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_round(x, digits, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: json_round(x, digits, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[json_round(value[f.name], digits, f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def softmax(scores: Column) -> Column:
    """Of an array of doubles; the largest score is taken off first. The largest and the sum are computed once."""
    both = F.struct(scores.alias("x"), F.array_max(scores).alias("top"))
    weights = bound(both, lambda s: F.transform(s["x"], lambda x: F.exp(x - s["top"])))
    summed = bound(weights, lambda w: F.struct(w.alias("w"), F.aggregate(w, F.lit(0.0), lambda a, x: a + x).alias("total")))
    return bound(summed, lambda s: F.transform(s["w"], lambda x: x / s["total"]))


def scaled(vector: Column, width: int) -> Column:
    """An embedding times the square root of its width."""
    return F.transform(vector, lambda x: x * F.sqrt(F.lit(float(width))))


def expected_period(prob: Column) -> Column:
    """The mean of t under the probabilities of t = 0, 1, ..."""
    weighted = F.transform(prob, lambda p, t: p * t)
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def padded(ids: Column, width: Column, pad: int, last: int | None = None) -> Column:
    """Filled up with ``pad`` to ``width``, then ``last``."""
    fill = F.array_repeat(F.lit(pad).cast("long"), (width - F.size(ids)).cast("int"))
    out = F.concat(ids, fill)
    return F.concat(out, F.array(F.lit(last).cast("long"))) if last is not None else out


def ids_to_text(ids: Column, names: Column) -> Column:
    """Tokens of ids by a map<long, string>, joined by spaces."""
    return F.array_join(F.transform(ids, lambda i: F.element_at(names, i)), " ")


def is_float_text(token: Column) -> Column:
    """Text that a float can be read from: numbers with an exponent or digit separators, nan, inf, infinity."""
    digits = r"\d(?:_?\d)*"
    number = rf"(?:{digits}\.?(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?"
    return F.trim(token).rlike(rf"^\s*[+-]?(?:{number}|(?i:nan|inf|infinity))\s*$")


def characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def tokenize(text: Column, stopwords: Sequence[str] = ("", " ", "_"), segments: Column | None = None) -> Column:
    """Words, single CJK characters and punctuation marks; text of a number is taken apart into characters.

    ``segments`` takes the place of the built-in segmentation (an array column, as from ``segmented``).
    """
    pattern = r"[㐀-鿿]|[+-]?\d+(?:\.\d+)?|[\p{L}\p{M}\p{N}&&[^㐀-鿿]]+|[^\s]"
    words = segments if segments is not None else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.flatten(F.transform(words, lambda w: F.when(is_float_text(w), characters(w)).otherwise(F.array(w))))


def segmented(lcut: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A pluggable segmenter as a pandas UDF (each different text of a batch is cut once)."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        known = {t: list(lcut(t)) for t in texts.dropna().unique()}
        return texts.map(lambda t: known.get(t))

    return run


def kind_of(value: Column) -> Column:
    """s, n, b, z or j: string, number, boolean, null or nested value of a VARIANT."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), "z")
        .when(schema == "STRING", "s")
        .when(schema == "BOOLEAN", "b")
        .when(schema.startswith("ARRAY") | schema.startswith("OBJECT"), "j")
        .otherwise("n")
    )


def value_key(value: Column, nested: bool = False) -> Column:
    """Text that is equal for VARIANTs that compare as equal: 1 = 1.0 = true, null = null, '1' is other.

    Arrays and objects raise; with ``nested`` they compare by their text.
    """
    kind = kind_of(value)
    number = F.when(kind == "b", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(F.try_variant_get(value, "$", "double"))
    json = F.concat(F.lit("j:"), F.to_json(value)) if nested else F.raise_error(F.lit("a foreign key can't be an array or an object")).cast("string")
    return (
        F.when(kind == "z", "z")
        .when(kind == "s", F.concat(F.lit("s:"), F.try_variant_get(value, "$", "string")))
        .when(kind == "j", json)
        .otherwise(F.concat(F.lit("n:"), number.cast("string")))
    )


def float_text(number: Column) -> Column:
    """A double's shortest text that reads back as it: with a point, or an exponent of two digits below 1e-4 and from 1e16.

    Where two texts of that length do, the last digit may be either one's.
    """

    def shown(text: Column) -> Column:
        mantissa, power = F.split_part(text, F.lit("e"), F.lit(1)), F.split_part(text, F.lit("e"), F.lit(2)).cast("int")
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
        size, far = F.length(digits), F.abs(power).cast("string")
        rest = F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        wide = F.concat(F.substr(digits, F.lit(1), F.lit(1)), rest, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(far, F.greatest(F.lit(2), F.length(far)), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        filled = F.rpad(digits, F.greatest(power + 1, size), F.lit("0"))
        large = F.concat(F.substr(filled, F.lit(1), power + 1), F.lit("."), F.coalesce(F.nullif(F.substr(filled, power + 2), F.lit("")), F.lit("0")))
        return F.when((power < -4) | (power >= 16), wide).when(power < 0, small).otherwise(large)

    def shortest(x: Column) -> Column:
        # of 15, 16 and 17 digits the first that reads back as the same number
        texts = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
        return F.when(texts[0].cast("double") == x, texts[0]).when(texts[1].cast("double") == x, texts[1]).otherwise(texts[2])

    sign = F.when(number < 0, "-").otherwise("")
    plain = bound(bound(F.abs(number), shortest), shown)
    return F.when(F.isnan(number), "nan").when(F.abs(number) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, plain))


def value_text(value: Column) -> Column:
    """A VARIANT as a scripting language prints it: None, True, False, 1, 1.0, 1e+20, text as it is; arrays and objects as JSON."""
    kind = kind_of(value)
    whole = F.schema_of_variant(value).isin("TINYINT", "SMALLINT", "INT", "BIGINT")
    return (
        F.when(kind == "z", "None")
        .when(kind == "b", F.initcap(F.try_variant_get(value, "$", "string")))
        .when((kind == "n") & ~whole, float_text(F.try_variant_get(value, "$", "double")))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )
