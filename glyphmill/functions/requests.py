"""Requests, errors and source reasons as codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MOST = {"ds_url": 500, "comment": 5000, "name": 120, "email": 200}
EMAIL = r"^[^\s@<>()\",;:]+@[^\s@<>()\",;:]+\.[^\s@<>()\",;:]+$"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def cleaned(value: Column, most: int, one_line: bool = False) -> Column:
    """Line ends as \\n, no control characters, trimmed, cut to most characters; null as empty."""
    v = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\r\n?", "\n"), CONTROLS, "")
    v = F.substring(F.regexp_replace(v, r"^\s+|\s+$", ""), 1, most)
    return F.regexp_replace(v, r"\s+", " ") if one_line else v


def feedback(ds_url: Column, rating: Column, email: Column, website: Column) -> Column:
    """struct(ok, code, field) of a form: a filled trap is spam, then the first field that is missing or wrong."""
    url, mail = cleaned(ds_url, MOST["ds_url"], True), cleaned(email, MOST["email"], True)

    def answer(ok: bool, code: str | None = None, field: str | None = None) -> Column:
        return F.struct(F.lit(ok).alias("ok"), F.lit(code).cast("string").alias("code"), F.lit(field).cast("string").alias("field"))

    return (
        F.when(F.trim(F.coalesce(website, F.lit(""))) != "", answer(False, "SPAM"))
        .when(url == "", answer(False, "MISSING_FIELD", "ds_url"))
        .when(~url.rlike(r"(?i)^https?://[^\s/?#]+"), answer(False, "INVALID_FIELD", "ds_url"))
        .when(~F.coalesce(rating.isin(1, 2, 3, 4, 5), F.lit(False)), answer(False, "MISSING_FIELD", "rating"))
        .when((mail != "") & ~mail.rlike(EMAIL), answer(False, "INVALID_FIELD", "email"))
        .otherwise(answer(True))
    )


def client_ip(forwarded: Column, remote: Column, trusted: Column) -> Column:
    """The last address of a trusted proxy's list, else the peer's, else 'unknown'."""
    parts = F.filter(F.transform(F.split(forwarded, ","), lambda s: F.trim(s)), lambda p: p != "")
    return F.coalesce(F.when(trusted, F.try_element_at(parts, F.lit(-1))), F.when(remote != "", remote), F.lit("unknown"))


def error_code(message: Column) -> Column:
    """struct(status, code)"""
    kind = F.regexp_extract(message, r"^UNREACHABLE:(\w+)", 1)

    def answer(status: int, code: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), code.alias("code"))

    return (
        F.when(F.startswith(message, F.lit("Blocked:")), answer(400, F.lit("BLOCKED")))
        .when(F.startswith(message, F.lit("Could not resolve hostname")), answer(400, F.lit("NOT_RESOLVED")))
        .when(kind != "", answer(422, F.concat(F.lit("UNREACHABLE_"), kind)))
        .otherwise(answer(500, F.lit("INTERNAL")))
    )


def entry_error(reason: Column, pages: Column) -> Column:
    """The message for an entry page that failed with a reason, null where other pages were read."""
    kind = F.when(reason == "TIMEOUT", "TIMEOUT").when(reason.rlike("^HTTP (401|403|429)$"), "REFUSED").when(reason == "HTTP 404", "NOT_FOUND").otherwise("FAILED")
    blocked = F.lit("Blocked: the address redirects to a private one")
    return F.when(reason == "BLOCKED", blocked).when(pages == 0, F.concat(F.lit("UNREACHABLE:"), kind, F.lit(" ("), F.coalesce(reason, F.lit("")), F.lit(")")))


def reason_key(reason: Column) -> Column:
    """The key of the text for a source's reason: HTTP answers by class, other codes as they are."""
    n = F.regexp_extract(reason, r"^HTTP_(\d{3})$", 1).try_cast("int")
    refused = n.isin(401, 403, 429)
    http = F.when(n.isin(404, 410), "srHttp404").when(refused, "srHttpRefused").when(n >= 500, "srHttpServer").otherwise("srHttpOther")
    return F.when(n.isNotNull(), http).otherwise(F.coalesce(reason, F.lit("")))


def used_text(kinds: Column) -> Column:
    """The keys of the texts for how a source was used, in order; 'usedNothing' for none."""
    names = {"component": "usedComponent", "tokens": "usedTokens", "manifest": "usedManifest", "schema": "usedSchema", "pattern": "usedPattern", "component_tab_unused": "usedTabUnused"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = F.filter(F.transform(kinds, lambda k: F.try_element_at(table, k)), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(kinds), F.lit(0)) > 0, known).otherwise(F.array(F.lit("usedNothing")))
