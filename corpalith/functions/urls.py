"""URLs: normal forms, extraction from prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that never identify a document.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid msclkid mc_cid mc_eid ref referrer source src share sharing_token e web _gl igshid si spm scmts from_channel trk "
    "trkcampaign originalsubdomain"
).split()


def host(url: Column) -> Column:
    """Lower-case host without ``www.`` and default port."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), ":(80|443)$", ""), "^www[.]", "")


def normalise(url: Column) -> Column:
    """Host, path without doubled or trailing slashes, and sorted query without tracking parameters; no scheme or fragment."""
    whole = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(whole, "^[^:]*://[^/?#]*([^?#]*)", 1), "/+", "/"), "/$", "")
    query = F.regexp_extract(whole, "^[^?#]*[?]([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    return F.concat(host(whole), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def extract(text: Column) -> Column:
    """Distinct http(s) URLs of a prose text in order, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"')\]}]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))
