"""Addresses: routing, allowed paths and origins, query parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_list, strip_slashes, trim_spaces

PREFIX_B = "/groq"  # fixed value: where vendor b is mounted
# The paths that may be asked of each vendor.
PATHS_A = r"^/models$|^/models/[A-Za-z0-9._-]+:generateContent$|^/models/[A-Za-z0-9._-]+:streamGenerateContent$"
PATHS_B = "^/models$|^/chat/completions$"


def route_upstream(path: Column) -> Column:
    """struct(vendor, path): 'b' and the path after the prefix, else 'a' and the whole path."""
    is_b = (path == PREFIX_B) | path.startswith(PREFIX_B + "/")
    rest = F.substring(path, len(PREFIX_B) + 1, 1 << 30)
    return F.struct(F.when(is_b, "b").otherwise("a").alias("vendor"), F.when(is_b, F.when(rest == "", "/").otherwise(rest)).otherwise(path).alias("path"))


def allowed_path(vendor: Column, path: Column) -> Column:
    """whether the vendor may be asked for the path."""
    return F.when(vendor == "b", path.rlike(PATHS_B)).otherwise(path.rlike(PATHS_A))


def allowed_origin(origin: Column, allowed: Column) -> Column:
    """whether an origin is in a comma-separated list, exactly."""
    return F.array_contains(split_list(allowed, ","), F.coalesce(origin, F.lit("")))


def drop_parameter(url: Column, name: str) -> Column:
    """the URL without the parameter; the others keep their order and spelling, and the fragment stays."""
    left = F.regexp_replace(url, rf"([?&]){name}=[^&#]*", "$1")
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(left, "&&+", "&"), r"\?&", "?"), r"[?&](#|\z)", "$1")
    return F.when(url.rlike(f"[?&]{name}="), tidy).otherwise(url)


def request_url(kind: Column, base: Column, path: Column, secret: Column, auth: str = "query") -> Column:
    """struct(url, header, value): an own key goes into the query or a bearer header, a proxy's token into a header of its own."""
    own, has = kind == "own", F.coalesce(secret, F.lit("")) != ""
    plain = F.concat(base, path)
    in_query = own & F.lit(auth == "query")
    return F.struct(
        F.when(in_query, F.concat(plain, F.lit("?key="), F.url_encode(F.coalesce(secret, F.lit(""))))).otherwise(plain).alias("url"),
        F.when(own & ~in_query, "Authorization").when(~own & has, "X-App-Token").alias("header"),
        F.when(own & ~in_query, F.concat(F.lit("Bearer "), F.coalesce(secret, F.lit("")))).when(~own & has, secret).alias("value"),
    )


def credential_chain(own_key: Column, custom_url: Column, custom_token: Column, shared_url: Column, shared_token: Column, vendor: str = "a", direct: str = "") -> Column:
    """Array of struct(kind, base, secret) to try, best first: an own key, a custom proxy, the shared one; those that are null or '' are left out."""
    prefix = PREFIX_B if vendor == "b" else ""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    one = lambda kind, there, base, secret: F.when(there, F.struct(F.lit(kind).alias("kind"), base.alias("base"), secret.alias("secret")))
    key, url = trim_spaces(own_key), strip_slashes(custom_url)
    chain = F.array(
        one("own", has(key), F.lit(direct), key),
        one("custom", url != "", F.concat(url, F.lit(prefix)), trim_spaces(F.coalesce(custom_token, F.lit("")))),
        one("shared", has(shared_url), F.concat(shared_url, F.lit(prefix)), shared_token),
    )
    return F.array_compact(chain)
