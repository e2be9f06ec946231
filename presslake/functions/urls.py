"""URL and host-name column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from presslake.functions.text import _col, strip

AUTHORITY = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def url_authority(url: Column | str) -> Column:
    """The part between `//` and the path, with any port and user kept; '' when there is none.

    A pattern is used because the built-in URL parser rejects addresses with stray characters, which
    feeds do contain.
    """
    return F.coalesce(F.regexp_extract(_col(url), AUTHORITY, 1), F.lit(""))


def url_host(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(url_authority(url)), r"^www\.", "")


def host_of(domain: Column | str) -> Column:
    """A domain as it is compared with the domain lists: lower case, without a leading `www.`."""
    return F.regexp_replace(F.lower(_col(domain)), r"^www\.", "")


def base_domain(domain: Column | str, two_part_suffixes: list[str] | None = None) -> Column:
    """The last two labels of a domain, so that a site and its subdomains share one key.

    `two_part_suffixes` (for example `co.uk`) lists endings that need a third label.
    """
    host = F.regexp_replace(F.lower(strip(domain)), r"^www\.", "")
    base = F.substring_index(host, ".", -2)
    if two_part_suffixes:
        base = F.when(base.isin(two_part_suffixes), F.substring_index(host, ".", -3)).otherwise(base)
    return base


def same_domain(left: Column | str, right: Column | str) -> Column:
    return host_of(left) == host_of(right)


def query_parameter(url: Column | str, name: str) -> Column:
    """Value of one query parameter; null when the address does not carry it."""
    value = F.regexp_extract(_col(url), r"\?[^#]*?" + name + r"=([^&#]*)", 1)
    return F.nullif(value, F.lit(""))


def host_matches(host: Column, domains: list[str], strict: bool = True) -> Column:
    """Whether a host is one of `domains` or a subdomain of one.

    `strict=False` accepts any host ending in the listed text, so `notcnn.com` passes for `cnn.com`.
    """
    if strict:
        return F.coalesce(host.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"), F.lit(False))
    out = F.lit(False)
    for d in domains:
        out = out | host.endswith(d)
    return F.coalesce(out, F.lit(False))


def host_contains(host: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | host.contains(d)
    return F.coalesce(out, F.lit(False))
