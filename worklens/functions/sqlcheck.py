"""Classification of proposed SQL: statement types, parse checks, destructive flags, changes.

There is no grammar here. Literals (plain, escape and dollar-quoted), quoted names and
comments, nested ones included, are blanked first, then statements are split and tested
with patterns. What this cannot see: syntax errors other than an unknown verb, a dangling
keyword, or unbalanced quotes and parentheses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklens import fixed
from worklens.functions.text import let, strip

_ESCAPED = r"(?<!\w)[eE]'(?:[^'\\]++|\\(?s:.)|'')*+'"
_PLAIN = r"'(?:[^']++|'')*+'"
_DOLLAR = r"(?<![\w$])\$((?:[A-Za-z_]\w*+)?)\$(?s:.*?)\$\2\$"
_QUOTED_NAME = r'"(?:[^"]++|"")*+"'
#: Group 1 is a literal or quoted name, group 2 the tag of a dollar-quoted one.
_QUOTED_OR_COMMENT = rf"({_ESCAPED}|{_PLAIN}|{_QUOTED_NAME}|{_DOLLAR})|--[^\n]*|/\*(?s:.*?)\*/"
_PIECE = rf"({_ESCAPED}|{_PLAIN}|{_QUOTED_NAME}|{_DOLLAR}|[^'\"$eE]++|(?s:.))"
#: Units of a scan that keeps track of comment depth.
_UNIT = r"""((?<!\w)[eE]'(?:[^'\\]++|\\(?s:.)|'')*+'|/\*|\*/|--|\n|\$(?:[A-Za-z_]\w*+)?\$|'|"|[^/*\-\n'"$eE]++|(?s:.))"""
_NESTED = r"/\*(?s:(?!\*/).)*/\*"
_TOKEN = rf"({_ESCAPED}|{_PLAIN}|{_QUOTED_NAME}|{_DOLLAR}|[\w$.]+|[^\s\w$.])"
_DROP = r"^DROP (" + "|".join(spelling for spelling, _ in fixed.DROP_KINDS) + r")\b"
_LEADING_CTE = r"^WITH .*?\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\b"


def without_comments(sql: Column) -> Column:
    """Comments removed; literals and quoted names are matched whole, so a ``--`` in them stays."""
    flat = F.regexp_replace(sql, _QUOTED_OR_COMMENT, "$1 ")
    return F.when(sql.rlike(_NESTED), _outside_comments(sql)).otherwise(flat)


def _outside_comments(sql: Column) -> Column:
    """The same for comments within comments: one pass over units with the depth as state.

    ``within`` is the opening of what the pass is in: a quote, a dollar tag, a comment or
    nothing.
    """

    def step(state: Column, unit: Column) -> Column:
        within, depth = state["within"], state["depth"]
        comment, line = within == "/*", within == "--"
        deeper = depth + F.when(unit == "/*", 1).when(unit == "*/", -1).otherwise(0)
        opens = unit.isin("/*", "--", "'", '"') | unit.rlike(r"^\$\w*\$$")
        ends = F.when(comment, deeper == 0).when(line, unit == "\n").otherwise(unit == within)
        return F.struct(
            F.when(within == "", F.when(opens, unit).otherwise("")).when(ends, "").otherwise(within).alias("within"),
            F.when(comment, deeper).when((within == "") & (unit == "/*"), 1).otherwise(0).alias("depth"),
            F.when(comment | line | ((within == "") & unit.isin("/*", "--")), F.when(ends & (within != ""), F.concat(state["text"], F.lit(" "))).otherwise(state["text"]))
            .otherwise(F.concat(state["text"], unit)).alias("text"),
        )

    start = F.struct(F.lit("").alias("within"), F.lit(0).alias("depth"), F.lit("").alias("text"))
    return F.aggregate(F.regexp_extract_all(sql, F.lit(_UNIT), F.lit(1)), start, step, lambda state: state["text"])


def blanked(sql: Column) -> Column:
    """Upper-case text without comments, literal contents and quoted-name contents."""
    def bare(piece: Column) -> Column:
        literal = piece.rlike(r"(?s)^(?:'.*'|[eE]'.*'|\$.*\$)$")
        name = piece.startswith('"') & piece.endswith('"') & (F.length(piece) > 1)
        return F.when(literal, F.lit("''")).when(name, F.lit('"Q"')).otherwise(piece)

    pieces = F.regexp_extract_all(without_comments(sql), F.lit(_PIECE), F.lit(1))
    text = F.array_join(F.transform(pieces, bare), "")
    return F.upper(strip(F.regexp_replace(text, r"\s+", " ")))


def statements(sql: Column) -> Column:
    """Blanked, non-empty statements of a ``;`` batch."""
    parts = F.transform(F.split(blanked(sql), ";"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def _top_level(statement: Column) -> Column:
    """The text outside all parentheses.

    Where no parenthesis is left after those without others in them are cut out, that is all;
    only nested or unbalanced ones need the depth.
    """
    simple = F.regexp_replace(statement, r"\([^()]*+\)", " ")
    outside = let(simple, lambda text: F.when(text.rlike("[()]"), _outside(statement)).otherwise(text))
    flat = F.trim(F.regexp_replace(outside, r"\s+", " "))
    return F.regexp_replace(flat, _LEADING_CTE, "$1")


def _outside(statement: Column) -> Column:
    """The text outside parentheses: one pass with the depth as state."""

    def step(state: Column, unit: Column) -> Column:
        depth = state["depth"]
        return F.struct(
            F.when(unit == "(", depth + 1).when(unit == ")", F.greatest(depth - 1, F.lit(0))).otherwise(depth).alias("depth"),
            F.concat(state["text"], F.when(unit.isin("(", ")"), " ").when(depth == 0, unit).otherwise("")).alias("text"),
        )

    units = F.regexp_extract_all(statement, F.lit(r"([()]|[^()]++)"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    return F.aggregate(units, start, step, lambda state: state["text"])


def _alter_reasons(flat: Column) -> Column:
    body = F.regexp_replace(flat, r"^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?\S+ (?:\* )?", "")

    def reason(command: Column) -> Column:
        c = F.trim(command)
        return (
            F.when(c.rlike(r"^DROP CONSTRAINT\b"), fixed.ALTER_REASON + "DropConstraint")
            .when(c.rlike(r"^DROP\b"), fixed.ALTER_REASON + "DropColumn")
            .when(c.rlike(r"^ALTER (?:COLUMN )?\S+ DROP NOT NULL\b"), fixed.ALTER_REASON + "DropNotNull")
            .when(
                c.rlike(r"^ALTER (?:COLUMN )?\S+ (?:SET DATA )?TYPE\b"),
                fixed.ALTER_REASON + "AlterColumnType",
            )
        )

    return F.filter(F.transform(F.split(body, ","), reason), lambda r: r.isNotNull())


def _reasons(flat: Column) -> Column:
    spelling = F.regexp_extract(flat, _DROP, 1)
    kinds = F.create_map(*[F.lit(text) for pair in fixed.DROP_KINDS for text in pair])
    no_where = ~flat.rlike(r"\bWHERE\b")
    single = (
        F.when(spelling != "", F.concat(F.lit("DROP "), F.try_element_at(kinds, spelling)))
        .when(flat.rlike(r"^TRUNCATE\b"), fixed.TRUNCATE_REASON)
        .when(flat.rlike(r"^DELETE FROM\b") & no_where, fixed.DELETE_REASON)
        .when(flat.rlike(r"^UPDATE\b") & no_where, fixed.UPDATE_REASON)
    )
    return F.when(flat.rlike(r"^ALTER TABLE\b"), _alter_reasons(flat)).otherwise(
        F.filter(F.array(single), lambda r: r.isNotNull())
    )


def destructive_reasons(parsed: Column) -> Column:
    """Reasons over all statements of an array made by :func:`statements`."""
    return F.flatten(F.transform(parsed, lambda s: let(_top_level(s), _reasons)))


def statement_types(parsed: Column) -> Column:
    """Leading verb of each statement."""
    return F.transform(parsed, lambda s: F.regexp_extract(s, r"^\(*\s*([A-Z]+)", 1))


def _broken(statement: Column) -> Column:
    opened = F.length(statement) - F.length(F.replace(statement, F.lit("("), F.lit("")))
    closed = F.length(statement) - F.length(F.replace(statement, F.lit(")"), F.lit("")))
    verb = F.regexp_extract(statement, r"^\(*\s*([A-Z]+)", 1)
    dangling = r"(?:\b(?:" + "|".join(fixed.DANGLING_WORDS) + r")|[,=(])$"
    return (
        ~verb.isin(*fixed.STATEMENT_VERBS)
        | (opened != closed)
        | statement.rlike(dangling)
        | F.replace(statement, F.lit("''"), F.lit("")).contains("'")
    )


def parse_error(sql: Column, parsed: Column) -> Column:
    """NULL when the SQL is accepted, else the message."""
    return (
        F.when(sql.isNull() | (strip(sql) == ""), fixed.EMPTY_SQL)
        .when(F.size(parsed) == 0, fixed.ONLY_COMMENTS)
        .when(F.exists(parsed, _broken), fixed.PARSE_ERROR)
    )


def check(sql: Column) -> Column:
    """``struct<parse_error, destructive, statement_types>`` of a ``;`` batch.

    A batch that is not accepted has no reasons and no types.
    """
    none = F.array().cast("array<string>")

    def facts(parsed: Column) -> Column:
        return let(
            parse_error(sql, parsed),
            lambda error: F.struct(
                error.alias("parse_error"),
                F.when(error.isNull(), destructive_reasons(parsed)).otherwise(none).alias("destructive"),
                F.when(error.isNull(), statement_types(parsed)).otherwise(none).alias("statement_types"),
            ),
        )

    return let(statements(sql), facts)


def flags(parse_ok: Column, destructive: Column) -> Column:
    """Reviewer flags in one text: parse failure first, then the destructive reasons."""
    failed = F.when(parse_ok, F.array().cast("array<string>")).otherwise(
        F.array(F.lit(fixed.PARSE_FAILED_FLAG))
    )
    return F.array_join(F.concat(failed, destructive), ", ")


def layout_free(sql: Column) -> Column:
    """Text that only differs when more than layout, comments or case of names differs."""
    tokens = F.regexp_extract_all(without_comments(sql), F.lit(_TOKEN), F.lit(1))
    folded = F.transform(tokens, lambda t: F.when(t.rlike(r"""^(?:['"]|[eE]'|\$.*\$$)"""), t).otherwise(F.upper(t)))
    return F.regexp_replace(F.array_join(folded, " "), r"(?: ;)+$", "")


def clauses(sql: Column) -> Column:
    """Clauses of a statement, one array element per clause keyword."""
    cut = F.regexp_replace(
        layout_free(sql),
        r" (?=(?:FROM|WHERE|GROUP BY|HAVING|ORDER BY|LIMIT|OFFSET|SET|VALUES|RETURNING|UNION)\b)",
        "\n",
    )
    return F.filter(
        F.split(F.coalesce(cut, F.lit("")), "\n"), lambda clause: clause != ""
    )


def without(some: Column, others: Column) -> Column:
    """Elements of ``some`` that are not in ``others``, repeats kept."""
    return F.filter(some, lambda c: ~F.array_contains(others, c))
