"""Base64 and token decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def base64_text(encoded: Column) -> Column:
    """Decode standard base64 to text, dropping bytes that are not UTF-8; NULL if the padding is wrong."""
    body = F.regexp_replace(encoded, "=+$", "")
    tail = F.length(body) % 4
    padding = F.length(encoded) - F.length(body)
    valid = (tail == 0) | ((tail == 2) & (padding == 2)) | ((tail == 3) & (padding >= 1))
    text = F.make_valid_utf8(F.try_to_binary(body, F.lit("base64")).cast("string"))
    return F.when(valid, F.replace(text, F.lit("\ufffd"), F.lit("")))


def token_text(part: Column) -> Column:
    """One part of a JSON web token as text; NULL unless it is UTF-8."""
    binary = F.try_to_binary(F.translate(part, "-_", "+/"), F.lit("base64"))
    return F.try_validate_utf8(binary.cast("string"))


def token_part(part: Column) -> Column:
    """One part of a JSON web token as a variant; NULL unless it is a JSON object in UTF-8."""
    parsed = F.try_parse_json(token_text(part))
    return let(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


#: The pieces of compact JSON: strings, words and numbers, and single signs.
JSON_PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\s,:\[\]{}]+|[,:\[\]{}]'
#: Letters that Python writes as an escape: control, format, surrogate, private and unassigned ones, and all spaces but one.
ESCAPED = r"[\p{C}\p{Z}&&[^ ]]"


def _quoted(text: Column) -> Column:
    """A string as Python writes it inside a list: in single quotes unless only those occur in it."""
    quote = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.lit('"')).otherwise(F.lit("'"))

    def letter(c: Column, mark: Column) -> Column:
        code = F.ascii(c)
        digits = F.lower(F.hex(code))
        return (
            F.when(c == "\\", F.lit("\\\\"))
            .when(c == mark, F.concat(F.lit("\\"), c))
            .when(c == "\n", F.lit("\\n"))
            .when(c == "\r", F.lit("\\r"))
            .when(c == "\t", F.lit("\\t"))
            .when(~F.rlike(c, F.lit(ESCAPED)), c)
            .when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        )

    letters = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return let(quote, lambda m: F.concat(m, F.array_join(F.transform(letters, lambda c: letter(c, m)), ""), m))


def nested_text(json: Column) -> Column:
    """A JSON list or object as Python prints it. Its pieces map one to one, so nesting of any depth needs no recursion."""

    def piece(p: Column) -> Column:
        text = F.try_variant_get(F.try_parse_json(p), "$", "string")
        return (
            F.when(p.startswith('"'), let(text, _quoted))
            .when(p.isin(",", ":"), F.concat(p, F.lit(" ")))
            .when(p == "true", F.lit("True"))
            .when(p == "false", F.lit("False"))
            .when(p == "null", F.lit("None"))
            .otherwise(p)
        )

    pieces = F.regexp_extract_all(json, F.lit(JSON_PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, piece), "")


def claim(part: Column, text: Column, name: str, default: str) -> Column:
    """A claim as Python prints it; ``default`` where the key is absent. ``part`` is the token part as a variant, ``text`` as
    text, which has the keys of an object in their order. Fractions in lists and objects are printed as Java does, which
    differs from 10^7 on.
    """
    value = F.try_variant_get(part, f"$.{name}", "variant")
    single = F.try_variant_get(part, f"$.{name}", "string")
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(default))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(single))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), nested_text(F.get_json_object(text, f"$.{name}")))
        .otherwise(single)
    )


def claim_kind(part: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(part, f"$.{name}", "variant"))
