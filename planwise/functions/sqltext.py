"""Columns over the text of flat SELECT statements: normal form, clauses, shape, tokens and their roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAUSES = ("select", "from", "where", "group by", "having", "order by")
#: What a clause ends at: any later clause or the end.
ENDS = {c: "|".join([*(f" {later} " for later in CLAUSES[i + 1 :]), "$"]) for i, c in enumerate(CLAUSES)}
SHAPE = {"where": "w", "group by": "g", "having": "h", "order by": "o"}
AGGREGATES = ("max", "min", "count", "avg", "sum")
OPERATORS = ("=", "!=", ">", "<", "<=", ">=", "<>")
JOINING = ("join", "on")
CONJUNCTIONS = ("and", "or")
TOKEN = r"<=|>=|<>|!=|[=<>(),*;]|[^\s=<>(),*;!]+"


def normalize(sql: Column) -> Column:
    """One line, no semicolon, clause words lower case, `N days)` and DATEADD as intervals, no `limit -1`."""
    text = F.trim(F.regexp_replace(F.regexp_replace(sql, r"[\r\n;]+", " "), r"\s+", " "))
    for clause in CLAUSES:
        text = F.regexp_replace(text, rf"(?i)\b{clause}\b", clause)
    text = F.regexp_replace(text, r"(\d+) days\)", "interval '$1 days')")
    text = F.regexp_replace(text, r"(?i)dateadd\((\w+), ?(-?\d+), ?([^()]+)\)", "$3 + interval '$2 $1'")
    return F.trim(F.regexp_replace(text, r"(?i) limit -1\b", ""))


def clause(sql: Column, name: str) -> Column:
    """A clause's text; empty where it is absent."""
    lead = "^select " if name == "select" else f" {name} "
    return F.regexp_extract(sql, f"{lead}(.*?)(?:{ENDS[name]})", 1)


def shape(sql: Column) -> Column:
    """The clauses present besides select and from: w g h o; n for where alone, s for none."""
    letters = F.concat(*[F.when(clause(sql, c) != "", letter).otherwise("") for c, letter in SHAPE.items()])
    return F.when(letters == "", "s").when(letters == "w", "n").otherwise(letters)


def tokens(text: Column) -> Column:
    """Tokens without punctuation."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1), lambda t: ~t.isin(",", ";"))


def template(sql: Column) -> Column:
    """The statement with its literals masked."""
    return F.regexp_replace(F.regexp_replace(sql, r"'[^']*'", "?"), r"\b\d+(?:\.\d+)?\b", "?")


def token_role(name: Column, token: Column, before: Column, before2: Column, after: Column, is_table: Column, is_column: Column) -> Column:
    """A token's role by the clause it stands in, its neighbours and the catalog."""
    low = F.lower(token)
    value = F.when(before2.isin(*AGGREGATES) | (before2 == ")"), F.lit("#aggregate_value"))
    return (
        F.when(low.isin(*JOINING), "join")
        .when(low.isin(*CONJUNCTIONS), "conjunction")
        .when(token.isin(*OPERATORS), "operator")
        .when(low.isin(*AGGREGATES) & (after == "("), "aggregator")
        .when(token.isin("(", ")", "*"), "parenthesis")
        .when(low.isin("asc", "desc"), "order_by_key")
        .when(is_table & (before == "join"), "#join_table")
        .when(is_table & (name == "from"), "#table")
        .when(is_column & (before == "("), F.concat(name, F.lit("#aggregate_column")))
        .when(is_column & (name == "from"), F.concat(name, F.lit("#join_column")))
        .when(is_column, F.concat(name, F.lit("#column")))
        .when(before.isin(*OPERATORS) & (name == "having"), "#aggregate_value")
        .when(before.isin(*OPERATORS), F.coalesce(value, F.concat(before2, F.lit("#value"))))
        .when(before == "like", "#like_value")
        .otherwise("other")
    )
