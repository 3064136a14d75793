"""Text building and escaping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the white space that ends of texts lose
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# fixed values: characters that LaTeX reads as commands, and their escapes
LATEX = (("&", r"\&"), ("%", r"\%"), ("_", r"\_"), ("#", r"\#"))


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.btrim(text, F.lit(SPACE))


def latex(text: Column) -> Column:
    """With LaTeX's special characters escaped."""
    for plain, escaped in LATEX:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def percent(value: Column, places: int = 2) -> Column:
    """A share as a percentage with fixed places; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value * 100))


def p_value(value: Column) -> Column:
    """A p value with four places, or ``<0.0001``; null stays null."""
    return F.when(value < 0.0001, "<0.0001").when(value.isNotNull(), F.format_string("%.4f", value))


def json_string(text: Column, ascii_only: bool = False) -> Column:
    """A JSON string literal; with ``ascii_only`` other characters become ``\\u`` escapes, in pairs beyond the basic plane."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(escaped))
    if ascii_only:
        unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        wide = lambda c: F.concat(unit(F.lit(0xD800) + F.shiftright(F.ascii(c) - 0x10000, 10)), unit(F.lit(0xDC00) + (F.ascii(c) - 0x10000).bitwiseAND(0x3FF)))
        escape = lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 0x10000, unit(F.ascii(c))).otherwise(wide(c))
        out = F.when(out.rlike(r"^[\x00-\x7f]*$"), out).otherwise(F.array_join(F.transform(F.split(out, ""), escape), ""))
    return F.concat(F.lit('"'), out, F.lit('"'))


def tokens_json(tokens: Column, ascii_only: bool = False) -> Column:
    """``{"tokens": [...]}`` with five fields a token, indented by two."""

    def one(t: Column) -> Column:
        text = lambda f: F.coalesce(json_string(t[f], ascii_only), F.lit("null"))
        whole = lambda f: F.coalesce(t[f].cast("string"), F.lit("null"))
        return F.concat(
            F.lit('    {\n      "id": '), whole("id"), F.lit(',\n      "form": '), text("form"), F.lit(',\n      "upos": '), text("upos"),
            F.lit(',\n      "head": '), whole("head"), F.lit(',\n      "deprel": '), text("deprel"), F.lit("\n    }"),
        )

    body = F.array_join(F.transform(tokens, one), ",\n")
    return F.when(F.size(tokens) == 0, F.lit('{\n  "tokens": []\n}')).otherwise(F.concat(F.lit('{\n  "tokens": [\n'), body, F.lit("\n  ]\n}")))


def token_lines(tokens: Column) -> Column:
    """``id``, tab and form of each token, a line each."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["id"].cast("string"), F.lit("\t"), t["form"])), "\n")
