"""Derived keys of items: normal URLs, content and similarity keys, hashes of what was sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import at_head, let, squeezed, trim, trimmed, without_last

TRACKING = ("fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
STOP_WORDS = ("a", "af", "an", "der", "en", "er", "et", "for", "i", "ikke", "med", "og", "om", "på", "the", "til")
BUCKET_SECONDS = 6 * 3600
MOST_WORDS = 6


def _decoded(s: Column, plus: bool) -> Column:
    return F.try_url_decode(s if plus else F.replace(s, F.lit("+"), F.lit("%2B")))


def _encoded(s: Column) -> Column:
    """Form encoding that leaves only letters, digits and -_.~ as they are."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _bad_escape(s: Column) -> Column:
    return F.contains(F.regexp_replace(s, "%[0-9A-Fa-f]{2}", ""), F.lit("%"))


def normalize_url(raw: Column) -> Column:
    """A URL without fragment, user and tracking parameters, the others sorted by key; host in lower case and without one leading "www.";
    slashes of the decoded path run together and none at its end. A URL without a scheme is taken as https; one with a broken escape is
    only trimmed and put in lower case. The path keeps its case."""
    full = F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    part = [F.regexp_extract(full, r"(?s)^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i) for i in range(1, 5)]
    scheme, authority, path, query = part
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(_decoded(path, False), "/+", "/"), "/+$", "")
    pairs = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.contains(x, F.lit(";")) & ~_bad_escape(x))
    pairs = F.transform(pairs, lambda x, i: F.struct(_decoded(F.substring_index(x, "=", 1), True).alias("k"), i.alias("i"), _decoded(F.regexp_replace(x, "(?s)^[^=]*=?", ""), True).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda x: ~x["k"].isin(*TRACKING)))
    query = F.array_join(F.transform(pairs, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    out = F.concat(F.lower(scheme), F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(raw == "", "").when(_bad_escape(F.regexp_replace(raw, "[?#].*$", "")) | raw.rlike(r"[\x00-\x1F\x7F]"), F.lower(trim(raw))).otherwise(out)


def content_key(title: Column, description: Column) -> Column:
    return F.sha1(F.lower(F.concat(title, description)))


def cache_key(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(title, content), 256)


def domain(link: Column) -> Column:
    """What comes before the first slash, without http:// and then https://, and without a leading "www."; "unknown" for none."""
    bare = F.regexp_replace(F.regexp_replace(link, "^http://", ""), "^https://", "")
    return F.when(link == "", "unknown").otherwise(F.lower(F.regexp_replace(F.substring_index(bare, "/", 1), r"^www\.", "")))


def sent_hash(title: Column, link: Column) -> Column:
    return F.left(F.sha2(F.concat(squeezed(F.lower(trim(title))), F.lit("|"), domain(link)), 256), F.lit(16))


def rfc1123(s: Column) -> Column:
    """A time like "Mon, 02 Jan 2006 15:04:05 -0700", or with a zone's name for UTC."""
    bare = F.regexp_replace(s, "^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(bare, " (?:GMT|UTC)$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss Z")))


def similarity_key(title: Column, description: Column, link: Column, published: Column, published_raw: Column, now: Column) -> Column:
    """host|words|bucket: up to six words that aren't stop words and have more than 2 bytes (if there are none, the first six), and the
    start of the six hours in which the item was published, in seconds. `now` stands in for an unknown time."""
    host = F.lower(F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#]*)", 1))
    host = F.when(host == "", "unknown").otherwise(host)
    text = F.lower(trimmed(F.concat(title, F.lit(" "), description)))

    def words(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"[^\p{L}\p{N}]+", " ")
        return F.filter(F.split(bare, " "), lambda x: x != "")

    def telling(w: Column) -> Column:
        return F.filter(w, lambda x: (F.octet_length(x) > 2) & ~x.isin(*STOP_WORDS))

    # A tag may be open where the head ends, and its last word may go on.
    head = lambda h: F.when(F.contains(h, F.lit("<")), F.slice(F.split(F.lit(""), " "), 1, 0)).otherwise(telling(without_last(words(h))))
    whole = lambda t: let(words(t), lambda w: let(telling(w), lambda x: F.when(F.size(x) > 0, x).otherwise(w)))
    picked = F.slice(at_head(text, head, whole, MOST_WORDS), 1, MOST_WORDS)
    at = F.unix_seconds(F.coalesce(published, rfc1123(published_raw), now))
    return F.concat_ws("|", host, F.array_join(picked, "_"), (at - F.pmod(at, F.lit(BUCKET_SECONDS))).cast("string"))
