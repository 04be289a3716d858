"""Error structs: ``struct<kind, code, type, message, category>``, null = fine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard import rules

ERROR_TYPE = "struct<kind:string,code:int,type:string,message:string,category:string>"


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def error(kind: str, message: Column | str, category: Column | str | None = None) -> Column:
    code, type_ = rules.ERRORS[kind]

    def text(value: Column | str | None) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(code).alias("code"),
        F.lit(type_).alias("type"),
        text(message).alias("message"),
        text(category).alias("category"),
    )


def classify(kind: Column, message: Column, category: Column) -> Column:
    """Error struct for a column of error kinds; only security errors carry a
    category and rate limiting has a message of its own."""
    out = no_error()
    for name in rules.ERRORS:
        text = F.lit(rules.MSG_RATE_LIMIT) if name == "rate_limited" else message
        cat = category if name == "security_blocked" else None
        out = F.when(kind == name, error(name, text, cat)).otherwise(out)
    return out


def envelope(err: Column) -> Column:
    """JSON body of an error response; a missing category is left out."""
    detail = F.struct(
        err["message"].alias("message"),
        err["type"].alias("type"),
        err["code"].alias("code"),
        err["category"].alias("category"),
    )
    return F.to_json(F.struct(detail.alias("error")))


def audit_text(err: Column) -> Column:
    """The error as one line of text, the way audit records quote it."""
    return (
        F.when(err["kind"] == "security_blocked", F.concat(F.lit(rules.MSG_SECURITY_PREFIX), err["message"]))
        .when(err["kind"] == "bad_request", F.concat(F.lit("Bad request: "), err["message"]))
        .otherwise(err["message"])
    )
