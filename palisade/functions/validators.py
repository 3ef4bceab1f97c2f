"""Checks that a pattern alone can't make, as column expressions over one normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CARD = r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
_URL = r"(?U)https?://[^\s<>]+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
_LONG = r"(?U)\b[a-zA-Z0-9_+/=-]{24,}\b"

#: What a text has if the check of a policy can find anything (patterns of the scan).
POSSIBLE = {
    "CREDIT_CARD": r"(?:\d[ -]?){13}",
    "IP_ADDRESS": r":[0-9a-f.]*:|[0-9](?:\.[0-9]+){3}",
    "ENTROPY": r"(?<![a-z0-9_+/=-])[a-z0-9_+/=-]{24}",
    "CONNECTION_STRING": r"https?://",
    "INTERNAL_DOMAIN": r"https?://",
}
URL = POSSIBLE["CONNECTION_STRING"]
#: What the text has to have anywhere for that.
BESIDES = {"ENTROPY": r"\d"}


def luhn(value: Column) -> Column:
    """13 to 19 ASCII digits, not all the same, whose check digit is right; other characters are ignored."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    varied = F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) > 0
    return F.length(digits).between(13, 19) & varied & F.call_function("luhn_check", digits)


def has_card(value: Column) -> Column:
    return value.rlike(r"\p{Nd}") & F.exists(F.regexp_extract_all(value, F.lit(_CARD), F.lit(0)), luhn)


def is_ip(token: Column) -> Column:
    """A valid IPv4 address without leading zeros, or a valid IPv6 address."""
    parts = F.split(token, ":")
    filled = F.filter(parts, lambda p: p != "")
    last = F.element_at(parts, -1)
    v4_tail = last.rlike(_IPV4)
    groups = F.size(filled) + v4_tail.cast("int")
    fields = F.forall(filled, lambda p: p.rlike("^[0-9a-f]{1,4}$") | (p.rlike(_IPV4) & (p == last)))
    dots = F.size(F.filter(filled, lambda p: p.contains(".")))
    gap = F.size(F.split(token, "::")) == 2
    edges = ~token.rlike("^:[^:]|[^:]:$|:::")
    v6 = fields & edges & (dots <= v4_tail.cast("int")) & ((gap & (groups <= 7)) | (~token.contains("::") & (groups == 8)))
    return token.rlike(_IPV4) | (token.contains(":") & v6)


def has_ip(value: Column) -> Column:
    tokens = F.regexp_extract_all(value, F.lit("[0-9a-f:.]*[:.][0-9a-f:.]*"), F.lit(0))
    possible = value.rlike(r":[0-9a-f.]*:|[0-9](?:\.[0-9]+){3}")
    return possible & F.exists(tokens, lambda t: is_ip(F.regexp_replace(t, r"^\.+|\.+$", "")))


def _netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def _urls(value: Column) -> Column:
    return F.when(value.contains("://"), F.regexp_extract_all(value, F.lit(_URL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def has_internal_host(value: Column, domains: list[str]) -> Column:
    """A configured (normalised) domain anywhere, or a URL whose host ends like a private one."""
    host = lambda u: F.regexp_extract(F.regexp_replace(_netloc(u), r"^.*@", ""), r"^([^:\[\]]*)", 1)
    found = F.exists(_urls(value), lambda u: host(u).rlike(r"\.(?:local|internal|corp)$"))
    for domain in domains:
        found = found | value.contains(domain)
    return found


def has_url_user(value: Column) -> Column:
    return F.exists(_urls(value), lambda u: _netloc(u).contains("@"))


#: A bracketed host: an IPv6 address, perhaps with a zone, or an address of a later version.
_LATER = r"^v[0-9a-f]+\.[a-z0-9._~!$&'()*+,;=:-]+\z"


def _broken(url: Column) -> Column:
    """Whether a URL can't be split: brackets that don't pair, text around them, or no address in them."""
    netloc = _netloc(url)
    host = F.regexp_replace(netloc, r"^.*@", "")
    inside = F.regexp_extract(host, r"^\[([^\[\]]*)\](?::[^\[\]]*)?\z", 1)
    # a zone follows the address: what a percent sign cuts off
    address = is_ip(F.substring_index(inside, "%", 1)) & inside.contains(":") & ~inside.rlike("%(?:$|.*%)")
    whole = host.rlike(r"^\[[^\[\]]*\](?::[^\[\]]*)?\z")
    bracketed = netloc.contains("[") | netloc.contains("]")
    return bracketed & ~(whole & (address | inside.rlike(_LATER)))


def has_broken_url(value: Column) -> Column:
    """A URL that can't be split, so that the prompt can't be judged."""
    return F.exists(_urls(value), _broken)


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character."""
    n = F.length(token)
    term = lambda c: (F.lit(1.0) * (n - F.length(F.replace(token, c, F.lit("")))) / n)
    return F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda acc, c: acc - F.when((c == "") | (term(c) == 0), 0.0).otherwise(term(c) * F.log2(term(c))))


def has_random_token(value: Column, bits: float = 4.1) -> Column:
    tokens = F.regexp_extract_all(value, F.lit(_LONG), F.lit(0))
    return value.rlike(r"[a-zA-Z0-9_+/=-]{24}") & F.exists(tokens, lambda t: t.rlike("(?U)\\d") & (entropy(t) >= bits))
