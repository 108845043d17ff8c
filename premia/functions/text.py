"""Column functions on text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters on which whitespace splitting breaks (ASCII blanks, the four
# separator controls, NEL and all Unicode separators).
BLANK_CLASS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"
BLANKS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_blanks(text: Column) -> Column:
    """Drop leading and trailing whitespace, Unicode blanks included."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip_blanks(text), F.lit("")) == ""


def words(text: Column) -> Column:
    """Whitespace words in order, without empty ones."""
    return F.array_remove(F.split(text, rf"{BLANK_CLASS}+", -1), "")


def short_id(value: Column) -> Column:
    """First eight characters."""
    return F.substring(value.cast("string"), 1, 8)


def citation(document_id: Column, page: Column, unknown: str = "unknown") -> Column:
    """``[Doc xxxxxxxx, p.N]``."""
    return F.concat(
        F.lit("[Doc "),
        short_id(F.coalesce(document_id.cast("string"), F.lit(unknown))),
        F.lit(", p."),
        F.coalesce(page.cast("string"), F.lit("?")),
        F.lit("]"),
    )


def speaker_line(role: Column, content: Column, limit: int) -> Column:
    """``USER: text`` with the text cut at ``limit`` characters."""
    return F.concat(F.upper(role), F.lit(": "), F.substring(content, 1, limit))


def render_rows(rows: Column) -> Column:
    """``array<array<string>>`` as lines of cells joined by `` | ``; null cells are empty."""
    return F.array_join(
        F.transform(
            rows,
            lambda row: F.array_join(
                F.transform(row, lambda cell: strip_blanks(F.coalesce(cell, F.lit("")))), " | "
            ),
        ),
        "\n",
    )


def normalize_sql(reply: Column) -> Column:
    """A model's SQL reply reduced to one statement.

    Code fences go, text before the first word SELECT goes, text after the first ``;`` goes.
    """
    bare = F.regexp_replace(reply, "(?i)```(?:sql)?", "")
    # each step refers to the one before it once, so nothing is computed twice
    from_select = F.regexp_replace(bare, r"(?is)\A.*?\b(?=SELECT\b)", "")
    return strip_blanks(F.regexp_replace(from_select, r"(?s);.*\z", ";"))


def strip_json_fence(reply: Column) -> Column:
    """The text between a reply's opening fence and the next one; other replies unchanged."""
    trimmed = strip_blanks(reply)
    inner = F.element_at(F.split(trimmed, "```", -1), 2)
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 2147483647)).otherwise(inner)
    return F.when(trimmed.startswith("```"), inner).otherwise(trimmed)


def iso_time(value: Column) -> Column:
    """ISO-8601 without zone; microseconds only when there are any."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def minute_time(value: Column) -> Column:
    """``YYYY-MM-DD HH:MM UTC``."""
    return F.concat(F.date_format(value, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
