"""Column expressions for logs, names, tags and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Categories of error messages in order, each with the texts that must occur (any of the groups, all of a group).
ERROR_RULES = (
    ("Parse Syntax Error", (("[PARSE_SYNTAX_ERROR]",),)),
    ("Parse Empty Statement", (("[PARSE_EMPTY_STATEMENT]",),)),
    ("Missing Column", (("[MISSING_COLUMN]",),)),
    ("Requires Unity Catalog", (("[OPERATION_REQUIRES_UNITY_CATALOG]",),)),
    ("Catalog namespace is not supported", (("Catalog namespace is not supported",),)),
    ("Timeout Error", (("timed out",),)),
    ("Executor Lost Failure", (("ExecutorLostFailure",),)),
    ("Stage Failure", (("stage failure",),)),
    ("Database not found", (("Database", "not found"),)),
    ("Table not found", (("Table", "not found"),)),
    ("Database already exists", (("Database", "already exists"),)),
    ("Table already exists", (("Table", "already exists"),)),
    ("Column already exists", (("column", "already exists"),)),
    ("Describe on View", (("is a view. DESCRIBE DETAIL is only supported for tables.",),)),
    ("Permission Error", (("permission",), ("User does not own",))),
    ("Data Type Mismatch", (("data type mismatch",),)),
    ("Ambiguous Column", (("ambiguous",),)),
    ("Delta Protocol Error", (("protocol",),)),
)


def categorize(text: Column, rules: Sequence[tuple[str, Sequence[Sequence[str]]]] = ERROR_RULES, default: str = "Other") -> Column:
    """The category of the first rule that a text meets; "" for a null or empty text. Case counts."""
    out = F.lit(default)
    for name, groups in reversed(rules):
        meets = F.lit(False)
        for group in groups:
            every = F.lit(True)
            for words in group:
                every = every & F.contains(text, F.lit(words))
            meets = meets | every
        out = F.when(meets, name).otherwise(out)
    return F.when(text.isNull() | (text == ""), "").otherwise(out)


def access_kind(privilege: Column) -> Column:
    """Edit, Read or Unknown; the underscore in patterns is a literal one."""
    p = F.upper(privilege)
    edit = p.isin("ALL_PRIVILEGES", "ALL PRIVILEGES", "MODIFY", "OWN", "MANAGE", "APPLY_TAG", "REFRESH") | p.like(r"CREATE%") | p.like(r"WRITE\_%")
    return F.when(edit, "Edit").when(p.isin("SELECT", "EXECUTE", "BROWSE", "USAGE") | p.like(r"USE%") | p.like(r"READ\_%"), "Read").otherwise("Unknown")


def query_tag(text: Column, tag: str = "QUERY_TAG", default: str = "UNTAGGED") -> Column:
    """The value of `-- TAG: value` or `/* TAG=value */` in a statement."""
    found = F.regexp_extract(text, rf"(?i){tag}\s*[:=]\s*([A-Za-z0-9_.-]+)", 1)
    return F.when(F.length(found) > 0, found).otherwise(default)


def qualified_name(name: Column, catalog: str = "spark_catalog", schema: str = "default") -> Column:
    """catalog.schema.table from a name of one to three parts."""
    parts = F.reverse(F.split(F.lower(F.replace(name, F.lit("`"), F.lit(""))), r"\."))
    return F.concat_ws(".", F.coalesce(F.get(parts, 2), F.lit(catalog)), F.coalesce(F.get(parts, 1), F.lit(schema)), F.get(parts, 0))


def person_name(name: Column) -> dict[str, Column]:
    """Parts of "LAST,FIRST MIDDLE"."""
    rest = F.trim(F.split_part(name, F.lit(","), F.lit(2)))
    return {"last_name": F.trim(F.split_part(name, F.lit(","), F.lit(1))), "first_name": F.split_part(rest, F.lit(" "), F.lit(1)), "middle_name": F.nullif(F.trim(F.split_part(rest, F.lit(" "), F.lit(2))), F.lit(""))}


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    n = F.length(part)
    return F.coalesce(F.try_divide(F.length(text) - F.length(F.replace(text, part, F.lit(""))), n).cast("long"), F.lit(0))


def first_of(cases: Sequence[tuple[Column, str]], default: str = "Other") -> Column:
    """The label of the first column that isn't null."""
    out = F.lit(default)
    for column, label in reversed(cases):
        out = F.when(column.isNotNull(), label).otherwise(out)
    return out


def cast_to(schema: T.StructType, json_column: str | None = None) -> list[Column]:
    """Cast expressions for a schema, from columns of the same name or from a JSON text."""
    if json_column is None:
        return [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]
    return [F.get_json_object(json_column, f"$.{f.name}").cast(f.dataType).alias(f.name) for f in schema.fields]


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def visible_rows(df: DataFrame, permissions: DataFrame, user: str | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Rows that a permission row of this user (None: whoever runs the query) covers (columns: user_name and those of `on`)."""
    who = F.current_user() if user is None else F.lit(user)
    return df.join(permissions.where(F.col("user_name") == who).select(*on), list(on), "left_semi")


def masked(df: DataFrame, columns: Sequence[str], clear_for: Sequence[str] = ()) -> DataFrame:
    """Columns as masked text (letters and digits stand for themselves no more), but for the users in `clear_for`, told by
    who runs the query."""
    clear = F.current_user().isin(*clear_for) if clear_for else F.lit(False)
    return df.withColumns({c: F.when(clear, F.col(c).cast("string")).otherwise(F.mask(F.col(c).cast("string"))) for c in columns})


def register(spark: SparkSession) -> None:
    """SQL functions of this library, for the session."""
    for text in (
        "query_tag(stmt STRING, tag STRING DEFAULT 'QUERY_TAG', missing STRING DEFAULT 'UNTAGGED') RETURNS STRING RETURN coalesce(nullif(regexp_extract(stmt, concat('(?i)', tag, '\\\\s*[:=]\\\\s*([A-Za-z0-9_.-]+)'), 1), ''), missing)",
        "safe_ratio(a DOUBLE, b DOUBLE, missing DOUBLE DEFAULT 0) RETURNS DOUBLE RETURN coalesce(try_divide(a, b), missing)",
        "epoch_time(millis BIGINT) RETURNS TIMESTAMP RETURN CASE WHEN millis BETWEEN 946684800000 AND 4102444800000 THEN timestamp_millis(millis) END",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


def inline_views(statement: str, definitions: dict[str, str]) -> str:
    """A statement with view names, as whole words and in any case, replaced by their queries in brackets."""
    import re

    for name, body in definitions.items():
        statement = re.sub(rf"(?<![\w.`]){re.escape(name)}(?![\w`])", lambda _, b=body: f"({b})", statement, flags=re.I)
    return statement


def statements(script: str) -> list[str]:
    """The statements of a script; a semicolon within quotes or comments ends none, and comments alone make none."""
    import re

    token = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|.", re.S)
    out, now, says = [], "", False
    for m in [*token.finditer(script), None]:
        text = m.group() if m else ";"
        if text == ";":
            if says:
                out.append(now.strip())
            now, says = "", False
        else:
            now += text
            says |= bool(text.strip()) and not text.startswith(("--", "/*"))
    return out
