"""Reads generated statements as columns: one fold from left to right over the signs of each statement.

Spark's own parser decides on a statement that is run. A log of statements is screened without leaving the
executors, so this reads less than a parser does, and whatever it cannot place counts against the statement.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Pieces of a statement: marks of comments and quotes, words, blanks without line ends, single signs.
_PIECE = r"(?s)/\*\+|/\*|\*/|--|\|>|://|\$\{|[\p{L}\p{N}_]+|[^\S\r\n]+|."
_WORD = r"^[\p{L}\p{N}_]+$"

#: What a piece belongs to.
CODE, LINE, TEXT, NAME, TICKED = range(5)

# Places in a statement. A comma leads to another table in TABLE, FROM and LATER, since a word that
# ends the FROM clause may also be an alias there.
START, SELECTED, BRACKET, CALL, TABLE, FROM, LATER, SORTED = (
    "start", "selected", "bracket", "call", "table", "from", "later", "sorted")

_SET_WORDS = ("UNION", "INTERSECT", "EXCEPT", "MINUS", "SETMINUS")
_LATER_WORDS = ("WHERE", "HAVING", "WINDOW", "LIMIT", "OFFSET", "FETCH", "QUALIFY")
_SORT_WORDS = ("GROUP", "ORDER", "SORT", "CLUSTER", "DISTRIBUTE")
_FROM_CALLS = ("EXTRACT", "TRIM", "SUBSTRING", "SUBSTR", "OVERLAY")
_CODE_CALLS = ("REFLECT", "TRY_REFLECT", "JAVA_METHOD")
_REFUSED_PIECES = ("/*+", "|>", "://", "${", "\\")


def _first() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(CODE).alias("mode"), F.lit(0).alias("deep"), F.lit(False).alias("escaped"),
        F.lit("").alias("raw"), F.lit("").alias("quoted"), none.alias("around"), F.lit(START).alias("place"),
        F.lit("").alias("last"), F.lit(False).alias("named"), none.alias("tables"), F.lit(False).alias("unmatched"),
        F.lit(False).alias("set_operation"), F.lit(False).alias("qualified"), F.lit(False).alias("refused"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _read(state: Column, piece: Column) -> Column:
    """The state after one more piece: first whether it is comment, literal, name or code, then its role."""
    mode, deep, escaped, raw = state["mode"], state["deep"], state["escaped"], state["raw"]
    code = (mode == CODE) & (deep == 0)
    opens = piece.isin("'", '"', "`")
    closes = (((mode == TEXT) & (piece == "'")) | ((mode == NAME) & (piece == '"'))) & ~escaped | ((mode == TICKED) & (piece == "`"))
    in_code = F.struct(
        F.when(piece == "--", LINE).when(piece == "'", TEXT).when(piece == '"', NAME).when(piece == "`", TICKED)
        .otherwise(CODE).alias("mode"),
        F.when(piece == "/*", 1).otherwise(0).alias("deep"), F.lit(False).alias("escaped"), F.lit("").alias("quoted"),
        (~opens & ~piece.isin("--", "/*", " ", "\n") & (F.trim(piece) != "")).alias("act"),
        piece.rlike(_WORD).alias("word"), F.lit(False).alias("name"), F.upper(piece).alias("token"),
        (piece.isin(*_REFUSED_PIECES)
         | (opens & (((F.lower(raw) == "r") & (piece != "`")) | ((raw == piece) & (piece != "'"))))).alias("odd"))
    line_ends = (mode == LINE) & ((piece == "\r") | ((piece == "\n") & ~escaped))
    # A quoted name or a literal counts where it closes.
    elsewhere = F.struct(
        F.when(closes | line_ends, CODE).otherwise(mode).alias("mode"),
        F.when(deep == 0, 0).when(piece == "/*", deep + 1).when(piece == "*/", deep - 1).otherwise(deep).alias("deep"),
        ((piece == "\\") & ((mode == LINE) | (mode.isin(TEXT, NAME) & ~escaped))).alias("escaped"),
        F.when(mode.isin(NAME, TICKED) & ~closes, F.concat(state["quoted"], piece)).otherwise("").alias("quoted"),
        closes.alias("act"), F.lit(False).alias("word"), (closes & (mode != TEXT)).alias("name"),
        F.when(mode == TEXT, "'").otherwise(F.concat(F.lit('"'), F.upper(state["quoted"]))).alias("token"),
        ((deep > 0) & (piece == "/*+")).alias("odd"))
    return _let(F.when(code, in_code).otherwise(elsewhere),
                lambda now: F.when(now["act"], _role(state, piece, now)).otherwise(_passed(state, piece, now)))


def _lexical(piece: Column, now: Column) -> list[Column]:
    return [*[now[c].alias(c) for c in ("mode", "deep", "escaped")], piece.alias("raw"), now["quoted"].alias("quoted")]


def _passed(state: Column, piece: Column, now: Column) -> Column:
    """The state after a piece without a role."""
    kept = ("around", "place", "last", "named", "tables", "unmatched", "set_operation", "qualified")
    return F.struct(*_lexical(piece, now), *[state[c].alias(c) for c in kept], (state["refused"] | now["odd"]).alias("refused"))


def _role(state: Column, piece: Column, now: Column) -> Column:
    """What a token does to the place in the statement, the tables and the verdict so far."""
    place, last, around, named = state["place"], state["last"], state["around"], state["named"]
    token, word, name = now["token"], now["word"], now["name"]
    nested = word & (last == "(") & token.isin("SELECT", "VALUES", "FROM", "WITH")
    facts = F.struct(
        (~name & (token == "(")).alias("opened"), (~name & (token == ")")).alias("closed"), nested.alias("nested"),
        ((place == TABLE) & (name | (word & ~nested & (token != "LATERAL")))).alias("table"),
        (word & (place != TABLE) & token.isin(*_SET_WORDS)).alias("set"))

    def after(is_: Column) -> Column:
        opened, closed = is_["opened"], is_["closed"]
        inside = F.when((place == TABLE) & ~named, TABLE).when(last.isin(*_FROM_CALLS), CALL).otherwise(BRACKET)
        new_place = (
            F.when(is_["table"], FROM)
            .when(opened, inside)
            .when(closed, F.coalesce(F.try_element_at(around, F.lit(-1)), F.lit(LATER)))
            .when((token == ",") & place.isin(TABLE, FROM, LATER), TABLE)
            .when(~word, place)
            .when((token == "SELECT") & ((place == START) | (last == "(")), SELECTED)
            .when(is_["nested"] & (token == "VALUES"), SELECTED)
            .when(is_["set"], START)
            .when(token == "JOIN", TABLE)
            .when((token == "FROM") & (place != CALL), TABLE)
            .when(token.isin(*_LATER_WORDS) & (place == FROM), LATER)
            .when((token == "BY") & last.isin(*_SORT_WORDS) & place.isin(FROM, LATER, SORTED), SORTED)
            .otherwise(place))
        new_around = (F.when(opened, F.array_append(around, F.when(place == TABLE, FROM).otherwise(place)))
                      .when(closed & (F.size(around) > 0), F.slice(around, 1, F.greatest(F.size(around) - 1, F.lit(0))))
                      .otherwise(around))
        refused = (state["refused"] | now["odd"] | (opened & (named | F.ltrim(last, F.lit('"')).isin(*_CODE_CALLS)))
                   | (word & ~is_["table"] & (token == "TABLE"))
                   | (~word & (token == "'") & ((last == "USING") | (place == TABLE)))
                   | (word & (token == "SELECT") & place.isin(TABLE, FROM, LATER, SORTED) & (last != "("))
                   | (is_["nested"] & (token == "WITH")))
        found = F.lower(F.when(name, F.substring(token, 2, 1 << 30)).otherwise(token))
        return F.struct(
            *_lexical(piece, now), new_around.alias("around"), new_place.alias("place"), token.alias("last"),
            is_["table"].alias("named"), F.when(is_["table"], F.array_append(state["tables"], found)).otherwise(state["tables"]).alias("tables"),
            (state["unmatched"] | (closed & (F.size(around) == 0))).alias("unmatched"),
            (state["set_operation"] | (is_["set"] & (F.size(around) == 0))).alias("set_operation"),
            (state["qualified"] | (named & (token == "."))).alias("qualified"), refused.alias("refused"))

    return _let(facts, after)


def scan(statement: Column) -> Column:
    """Struct of ``tables`` (lower case, in order) and flags: unmatched, set_operation, qualified, refused.

    Comments may be nested; quoted names are never clause words; a comma or JOIN after the FROM clause
    leads to a table wherever it could; a bracket may hold a query without SELECT. ``refused`` are hints, raw or open
    literals, open comments, code, TABLE and WITH clauses, table functions and signs no statement needs.
    """
    def verdict(state: Column) -> Column:
        return F.struct(
            F.array_distinct(state["tables"]).alias("tables"),
            (state["unmatched"] | (F.size(state["around"]) > 0)).alias("unmatched"),
            state["set_operation"].alias("set_operation"), state["qualified"].alias("qualified"),
            (state["refused"] | ~state["mode"].isin(CODE, LINE) | (state["deep"] > 0)).alias("refused"))

    pieces = F.regexp_extract_all(statement, F.lit(_PIECE), 0)
    return F.aggregate(pieces, _first(), _read, verdict)
