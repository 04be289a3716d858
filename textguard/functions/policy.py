"""Request validation and allowlist rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.errors import error, no_error
from textguard.functions.sse import json_string, trim_unicode
from textguard.functions.text import fill

VARIANTS = "array<variant>"
OBJECT = "map<string,variant>"


def member(variant: Column, path: str) -> Column:
    """The JSON value at ``path``; a JSON null is a value, absence is null."""
    return F.try_variant_get(variant, path, "variant")


def members(variant: Column, path: str) -> Column:
    """The JSON array at ``path``, null if there is none."""
    return F.try_variant_get(variant, path, VARIANTS)


def is_object(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", OBJECT).isNotNull()


def first_error(errors: Column) -> Column:
    return F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))


def tools_error(payload: Column, allowed_tools: Sequence[str] | None) -> Column:
    """First offending tool: shape first, then the allowlist (empty denies all,
    None asks for the shape alone)."""

    def check(tool: Column) -> Column:
        name = json_string(tool, "$.function.name")
        shaped = F.coalesce(json_string(tool, "$.type") == "function", F.lit(False))
        wrong = F.when(~shaped, error("bad_request", rules.MSG_TOOL_TYPE)).when(
            name.isNull(), error("bad_request", rules.MSG_TOOL_NAME)
        )
        if allowed_tools is None:
            return wrong
        allowed = name.isin(list(allowed_tools)) if allowed_tools else F.lit(False)
        return wrong.when(~allowed, error("security_blocked", fill(rules.MSG_TOOL_DENIED, name), rules.CAT_TOOL))

    tools = members(payload, "$.tools")
    return (
        F.when(member(payload, "$.tools").isNull(), no_error())
        .when(tools.isNull(), error("bad_request", rules.MSG_TOOLS_ARRAY))
        .otherwise(first_error(F.transform(tools, check)))
    )


def messages_error(payload: Column) -> Column:
    """First message without a valid role or without content (null is content)."""

    def check(message: Column, index: Column) -> Column:
        role = json_string(message, "$.role")
        valid = F.coalesce(role.isin(list(rules.ROLES)), F.lit(False))
        return F.when(~valid, error("bad_request", fill(rules.MSG_ROLE, index))).when(
            member(message, "$.content").isNull(), error("bad_request", fill(rules.MSG_CONTENT, index))
        )

    messages = members(payload, "$.messages")
    return (
        F.when(~is_object(payload), error("bad_request", rules.MSG_OBJECT))
        .when(messages.isNull() | (F.size(messages) == 0), error("bad_request", rules.MSG_MESSAGES))
        .otherwise(first_error(F.transform(messages, check)))
    )


def model_name(payload: Column, default_model: str = rules.DEFAULT_MODEL) -> Column:
    """The model asked for; the default if it is missing, empty or no string."""
    return F.coalesce(F.nullif(json_string(payload, "$.model"), F.lit("")), F.lit(default_model))


def is_streaming(payload: Column) -> Column:
    value = member(payload, "$.stream")
    return F.coalesce(
        (F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(payload, "$.stream", "boolean"),
        F.lit(False),
    )


def governance_error(
    category: str, target: Column | str, allowlist: Sequence[str], default_deny: bool = True
) -> Column:
    """Default-deny with exact matches; ``allowlist`` is a short list of settings."""
    target = target if isinstance(target, Column) else F.lit(target)
    if not default_deny:
        return no_error()
    listed = target.isin(list(allowlist)) if allowlist else F.lit(False)
    reason = fill(rules.MSG_GOVERNANCE, F.lit(category), target)
    return F.when(~listed, error("security_blocked", reason, category)).otherwise(no_error())


def auth_error(auth_ok: Column) -> Column:
    failed = ~F.coalesce(auth_ok, F.lit(False))
    return F.when(failed, error("security_blocked", rules.MSG_AUTH, rules.CAT_AUTH)).otherwise(no_error())


def empty_prompt_error(prompt: Column) -> Column:
    blank = F.coalesce(trim_unicode(prompt) == "", F.lit(True))
    return F.when(blank, error("bad_request", rules.MSG_EMPTY_PROMPT)).otherwise(no_error())


def ipv4_of(host: Column) -> Column:
    """Dotted form of a host that is an IPv4 address in one to four decimal, octal
    or hexadecimal parts; the host itself if its last part is no number; null if
    the numbers make no address."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")

    def number(part: Column) -> Column:
        return (
            F.when(part.rlike("^0x[0-9a-f]*$"), F.coalesce(F.conv(F.nullif(F.substring(part, 3, 99), F.lit("")), 16, 10), F.lit("0")))
            .when(part.rlike("^0[0-7]*$"), F.conv(part, 8, 10))
            .when(part.rlike("^[1-9][0-9]*$"), part)
            .try_cast("decimal(20,0)")
        )

    numbers, n = F.transform(parts, number), F.size(parts)
    last = F.element_at(numbers, -1)
    front = F.slice(numbers, F.lit(1), n - 1)
    room = F.pow(F.lit(256.0), 5 - n).cast("decimal(20,0)")
    fits = (n <= 4) & F.forall(numbers, lambda x: x.isNotNull()) & F.forall(front, lambda x: x <= 255) & (last < room)
    head = F.aggregate(front, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x.cast("bigint"))
    value = head * room.cast("bigint") + last.cast("bigint")
    dotted = F.concat_ws(".", *(F.shiftright(value, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
    numeric = F.element_at(parts, -1).rlike("^([0-9]+|0x[0-9a-f]*)$")
    return F.when(~numeric, host).when(F.coalesce(fits, F.lit(False)), dotted)


def url_host(url: Column) -> Column:
    """Host of a URL as a client reads it: without user and port, in lower case,
    percent signs decoded, IPv4 addresses dotted; null if it can't be one."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{0,2}([^/?#\\]*)", 1)
    rest = F.regexp_replace(rest, "^.*@", "")
    plain = F.lower(F.try_url_decode(F.replace(F.regexp_replace(rest, ":[0-9]*$", ""), F.lit("+"), F.lit("%2B"))))
    bracketed = F.lower(F.regexp_extract(rest, r"^(\[[^\]]*\])", 1))
    return F.when(F.startswith(rest, F.lit("[")), bracketed).otherwise(ipv4_of(plain))


def url_block_reason(
    url: Column, allow_localhost: bool = True, block_cloud_metadata: bool = True
) -> Column:
    """Why a URL must not be called, null if it may be."""
    # blanks around a URL and line breaks inside it are not read
    url = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    scheme = F.nullif(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))
    host = url_host(url)
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    local = (host == "localhost") | (bare == "::1") | F.startswith(host, F.lit("127."))
    metadata = F.startswith(host, F.lit(rules.METADATA_PREFIX)) | (host == rules.METADATA_HOST)
    return (
        F.when(scheme.isNull(), F.lit("Invalid upstream URL"))
        .when(~scheme.isin("http", "https"), fill(rules.MSG_URL_SCHEME, scheme))
        .when(host.isNull(), F.lit("Invalid upstream URL"))
        .when(host == "", F.lit(rules.MSG_URL_HOST))
        .when(F.lit(block_cloud_metadata) & metadata, fill(rules.MSG_URL_METADATA, host))
        .when(~F.lit(allow_localhost) & local, fill(rules.MSG_URL_LOCALHOST, host))
    )


def split_list(text: Column) -> Column:
    """Comma-separated setting: trimmed entries, empty ones dropped."""
    parts = F.transform(F.split(text, ","), trim_unicode)
    return F.filter(parts, lambda p: p != "")


