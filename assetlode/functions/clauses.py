"""The filter of a scan: the engine's own clause, the position, and an operator's clause that passes its checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the filter contract, in the order of the checks.
COMMENT_MARKERS = ("//", "/*", "*/")
CLAUSE_REFUSALS = ("comment_construct", "unbalanced_parentheses", "whitespace_only", "too_long")
CLAUSE_MAX = 2_048
KIND_CLAUSE = (
    '(req.path.like:"%.js%" OR req.path.like:"%.mjs%" OR resp.raw.like:"%javascript%" OR resp.raw.like:"%ecmascript%" OR resp.raw.like:"%jscript%"'
    ' OR resp.raw.like:"%livescript%" OR resp.raw.like:"%text/js%") AND resp.code.gte:200 AND resp.code.lt:300'
)

#: A quoted string with its escapes; one that isn't closed reaches to the end.
_STRING = r'(?s)"(?:\\.|[^"\\])*(?:"|\\?$)'


def balanced(clause: Column) -> Column:
    """Whether parentheses outside strings close, and none closes before it opens."""
    signs = F.regexp_replace(F.regexp_replace(clause, _STRING, ""), r"[^()]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "(", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(acc["least"], depth).alias("least"))

    end = F.aggregate(F.filter(F.split(signs, ""), lambda c: c != ""), start, step)
    return (end["depth"] == 0) & (end["least"] >= 0)


def clause_refusal(clause: Column) -> Column:
    """The first check that an operator's clause fails; null if it may be composed. An empty one passes."""
    comment = F.lit(False)
    for marker in COMMENT_MARKERS:
        comment = comment | clause.contains(marker)
    blank = (clause != "") & (F.regexp_replace(clause, "[\\s\\u00A0\\uFEFF]", "") == "")
    checks = (comment, ~balanced(clause), blank, F.length(clause) > CLAUSE_MAX)
    out = F.lit(None).cast("string")
    for reason, failed in reversed(list(zip(CLAUSE_REFUSALS, checks, strict=True))):
        out = F.when(failed, reason).otherwise(out)
    return out


def position_clause(last_id: Column) -> Column:
    """What lies below the last request that was walked; empty before the first page."""
    return F.when(last_id == "", "").otherwise(F.concat(F.lit("row.id.lt:"), last_id))


def composed(position: Column, operator: Column, kind: str = KIND_CLAUSE) -> Column:
    """The terms in parentheses; the kind is first and always there, an invalid operator's clause is left out."""
    wrapped = lambda c: F.concat(F.lit("("), c, F.lit(")"))
    return F.concat_ws(" AND ", F.lit(f"({kind})"), F.when(position != "", wrapped(position)), F.when((operator != "") & clause_refusal(operator).isNull(), wrapped(operator)))


def predicate(position: Column, last: Column, *terms: Column) -> Column:
    """The same as a filter of a DataFrame: below the last position, if there is one, and every term."""
    out = last.isNull() | (position < last)
    for term in terms:
        out = out & F.coalesce(term, F.lit(False))
    return out
