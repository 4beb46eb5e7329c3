"""Text functions, as column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks an answer as an error (fixed value of the interchange format).
ERROR_PREFIX = "Ошибка:"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def blank(x: Column) -> Column:
    """Whether there is nothing but white space; null is blank."""
    return F.coalesce(strip(x) == "", F.lit(True))


def is_error(x: Column) -> Column:
    return F.coalesce(strip(x).startswith(ERROR_PREFIX), F.lit(False))


def fenced(x: Column, language: str) -> Column:
    """The inside of the first fenced block of that language, in any letter case; without one, the whole text. Stripped."""
    block = rf"(?is)```{language}\s*(.*?)```"
    return strip(F.when(x.rlike(block), F.regexp_extract(x, block, 1)).otherwise(x))


def without_thoughts(x: Column) -> Column:
    """Without <think> parts, stripped."""
    return strip(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""))


def percent_encoded(x: Column) -> Column:
    """Percent-encoding of UTF-8 with no safe character but letters, digits and _.-~"""
    encoded = F.url_encode(x)
    for form, strict in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(strict))
    return encoded


def percent_decoded(x: Column) -> Column:
    """The inverse; text that isn't valid stays as it is. A plus sign is no space."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def html_escaped(x: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def data_uri(x: Column, kind: str = "image/jpeg") -> Column:
    """In one line: base64() puts line ends after each 76 characters."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(x), "\r\n", ""))


def json_object(x: Column) -> Column:
    """Text parsed as JSON; what is none becomes an empty object. Never null."""
    return F.coalesce(F.try_parse_json(x), F.parse_json(F.lit("{}")))


def json_row(*columns: str) -> Column:
    """A row as JSON, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def cited(evidence: Column, source: Column) -> Column:
    """The quote with its source; without a quote, the source alone."""
    return F.when(blank(evidence), F.coalesce(source, F.lit(""))).otherwise(F.concat(F.lit('"'), strip(evidence), F.lit('" ('), F.coalesce(source, F.lit("")), F.lit(")")))


def latin_only(x: Column) -> Column:
    """Whether all letters are Latin ones."""
    return ~x.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def read_only(query: Column) -> Column:
    """Whether a query text has no word that writes, outside of quoted strings."""
    bare = F.regexp_replace(query, r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''")
    return ~bare.rlike(r"(?i)\b(create|merge|delete|detach|set|remove|drop|load|foreach|call)\b")


def selects(query: Column) -> Column:
    """Whether an SQL text is a query that only reads, and calls no methods of the machine."""
    bare = F.regexp_replace(query, r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''")
    opens = bare.rlike(r"(?i)\A[\s(]*(select|with|values|from|table)\b")
    return read_only(query) & opens & ~bare.rlike(r"(?i)\b(insert|update|alter|truncate|into|cache|refresh|reflect|try_reflect|java_method)\b")


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced; null values are empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompt(*parts: Column) -> Column:
    """The parts that aren't blank, stripped, with an empty line between them. Never null."""
    return F.concat_ws("\n\n", *[F.when(~blank(p), strip(p)) for p in parts])


def joined(df: DataFrame, by: str, order: str, text: str, separator: str = " ") -> DataFrame:
    """(by, text): the texts of each group in their order. A group's texts are one value, so it must fit a row."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x[text]), separator).alias(text))
