"""Authentication schemes written about in a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom import patterns as p
from specloom.schemas import SECURITY_SCHEME


def _folded(text: Column) -> Column:
    # Besides upper and lower case, the patterns take dotless i and long s for i and s.
    return F.translate(F.lower(text), "ıſ", "is")


def mentions(text: Column, patterns) -> Column:
    """Any of the patterns is found, whatever the case; no match crosses a line."""
    return F.rlike(_folded(text), F.lit(p.any_of(patterns)))


def auth_families(text: Column) -> dict[str, Column]:
    """One boolean expression per family of authentication methods."""
    folded = _folded(text)

    def has_word(name):
        first, *others = [F.contains(folded, F.lit(word)) for word in p.AUTH_WORDS[name]]
        for other in others:
            first = first | other
        return first

    return {
        name: has_word(name) & F.rlike(folded, F.lit(p.any_of(found_by)))
        for name, found_by in p.AUTH_PATTERNS.items()
    }


def auth_header_name(text: Column) -> Column:
    """Name of the key header when the text quotes one, else the usual name."""
    # Every pattern captures at least one character: empty means not found.
    found = [
        F.nullif(F.regexp_extract(text, "(?iud)" + q, 1), F.lit(""))
        for q in p.HEADER_NAME_PATTERNS
    ]
    return F.coalesce(*found, F.lit(p.DEFAULT_HEADER_NAME))


def oauth2_flows(text: Column) -> Column:
    """Names of the OAuth flows a text mentions, in fixed order."""
    flows = [F.when(mentions(text, q), F.lit(name)) for name, q in p.OAUTH_FLOW_PATTERNS.items()]
    return F.array_compact(F.array(*flows))


def is_jwt(text: Column) -> Column:
    lowered = F.lower(text)
    return F.contains(lowered, F.lit("jwt")) | F.contains(lowered, F.lit("json web token"))


def _scheme(type_, description, name=None, location=None, scheme=None, bearer_format=None):
    def value(v):
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    return F.struct(
        value(type_).alias("type"),
        value(name).alias("name"),
        value(location).alias("location"),
        value(scheme).alias("scheme"),
        value(bearer_format).alias("bearer_format"),
        value(description).alias("description"),
    )


def detect_auth_schemes(text: Column) -> Column:
    """Array of the schemes a text describes, in fixed order."""
    family = auth_families(text)
    jwt, flows = is_jwt(text), oauth2_flows(text)
    oauth = F.when(
        F.size(flows) > 0, F.concat(F.lit("OAuth 2.0 ("), F.array_join(flows, ", "), F.lit(")"))
    ).otherwise("OAuth 2.0")
    bearer = F.concat(F.lit("Bearer token authentication"), F.when(jwt, " (JWT)").otherwise(""))
    schemes = {
        "api_key_header": _scheme(
            "apiKey",
            "API key authentication via header",
            name=auth_header_name(text),
            location="header",
        ),
        "api_key_query": _scheme(
            "apiKey",
            "API key authentication via query parameter",
            name="api_key",
            location="query",
        ),
        "bearer_token": _scheme(
            "http", bearer, scheme="bearer", bearer_format=F.when(jwt, F.lit("JWT"))
        ),
        "basic_auth": _scheme("http", "HTTP Basic authentication", scheme="basic"),
        "oauth2": _scheme("oauth2", oauth),
    }
    found = [F.when(family[name], scheme) for name, scheme in schemes.items()]
    return F.array_compact(F.array(*found)).cast(f"ARRAY<{SECURITY_SCHEME}>")


def is_similar_scheme(a: Column, b: Column) -> Column:
    """Same type, and same place (keys) or same scheme (http)."""
    return (a["type"] == b["type"]) & (
        F.when(a["type"] == "apiKey", a["location"].eqNullSafe(b["location"]))
        .when(a["type"] == "http", a["scheme"].eqNullSafe(b["scheme"]))
        .otherwise(F.lit(True))
    )


def merge_security_schemes(given: Column, detected: Column) -> Column:
    """All given schemes, then the detected ones that resemble none of them."""
    new = F.filter(detected, lambda d: ~F.exists(given, lambda g: is_similar_scheme(g, d)))
    return F.concat(given, new)
