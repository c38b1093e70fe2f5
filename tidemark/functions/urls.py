"""URL columns: parts, same-site and skip rules, priorities, regions, ids and safety. All are JVM expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Generic syntax: scheme, authority, path, query; every string splits, so nothing throws.
SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"

# Terms that suggest a page holds or lists legislation.
PRIORITY_TERMS = ["law", "legislation", "statute", "regulation", "directive", "act", "bill", "decree", "ordinance", "code", "energy", "energi", "heat", "warme", "wärme", "varme", "abwarme", "abwärme", "chaleur", "calor", "climate", "klima", "efficien", "gesetz", "recht", "loi", "ley", "lag", "lov", "laki", "wet"]

# Host suffix -> region tags.
SUFFIX_REGIONS = {
    ".gov.uk": ["uk"], ".gov.au": ["apac", "australia"], ".gov.sg": ["apac", "singapore"], ".gouv.fr": ["eu", "eu_central", "france"],
    ".gouv.qc.ca": ["north_america", "canada", "quebec"], ".gv.at": ["eu", "eu_central", "austria"], ".admin.ch": ["eu_central", "switzerland"], ".europa.eu": ["eu"],
    ".riksdagen.se": ["eu", "nordic", "sweden"], ".retsinformation.dk": ["eu", "nordic", "denmark"], ".go.jp": ["apac", "japan"], ".go.kr": ["apac", "south_korea"],
    ".gob.es": ["eu", "eu_south", "spain"], ".gov.it": ["eu", "eu_south", "italy"], ".gov.pl": ["eu", "eu_east", "poland"], ".gov.pt": ["eu", "eu_south", "portugal"],
    ".gov.cz": ["eu", "eu_east", "czech_republic"], ".gov.gr": ["eu", "eu_south", "greece"], ".gov.hu": ["eu", "eu_east", "hungary"], ".gov.ro": ["eu", "eu_east", "romania"],
    ".kormany.hu": ["eu", "eu_east", "hungary"], ".sejm.gov.pl": ["eu", "eu_east", "poland"], ".gov.in": ["apac", "india"], ".nic.in": ["apac", "india"],
    ".gov.br": ["south_america", "brazil"], ".gov.ae": ["middle_east", "uae"], ".gov.sa": ["middle_east", "saudi_arabia"], ".gob.mx": ["north_america", "mexico"],
    ".gov.za": ["africa", "south_africa"], ".gc.ca": ["north_america", "canada"], ".gov.bc.ca": ["north_america", "canada", "british_columbia"], ".gov": [],
    ".be": ["eu", "eu_west", "belgium"], ".fi": ["eu", "nordic", "finland"], ".no": ["eu", "nordic", "norway"], ".is": ["nordic", "iceland"],
    ".ie": ["eu", "eu_west", "ireland"], ".nl": ["eu", "eu_west", "netherlands"], ".se": ["eu", "nordic", "sweden"], ".dk": ["eu", "nordic", "denmark"],
    ".de": ["eu", "eu_central", "germany"], ".fr": ["eu", "eu_central", "france"], ".ch": ["eu_central", "switzerland"], ".at": ["eu", "eu_central", "austria"],
    ".au": ["apac", "australia"], ".jp": ["apac", "japan"], ".kr": ["apac", "south_korea"], ".sg": ["apac", "singapore"],
    ".ca": ["north_america", "canada"], ".in": ["apac", "india"], ".br": ["south_america", "brazil"], ".ae": ["middle_east", "uae"],
    ".sa": ["middle_east", "saudi_arabia"], ".mx": ["north_america", "mexico"], ".za": ["africa", "south_africa"],
}

# Two-letter names of states whose hosts have an id prefix of their own.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new-hampshire": "nh", "new-jersey": "nj",
    "new-mexico": "nm", "new-york": "ny", "north-carolina": "nc", "north-dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode-island": "ri", "south-carolina": "sc", "south-dakota": "sd", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west-virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy", "district-of-columbia": "dc",
}

# Signs of a denied page, in the order in which they are looked for.
DENIALS = [("cloudflare", "Cloudflare bot protection"), ("akamaighost", "Akamai WAF"), ("access denied", "Access Denied"), ("403 forbidden", "Forbidden"), ("bot detection", "bot detection"), ("rate limit", "rate limited"), ("sign in to continue", "sign-in required"), ("login required", "login required")]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 4)


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def same_site(link_netloc: Column, base_netloc: Column) -> Column:
    """URL-01: equal hosts but for www., or a subdomain of the base host."""
    link, base = bare_host(link_netloc), bare_host(base_netloc)
    return (link == base) | link.endswith(F.concat(F.lit("."), base))


def should_skip_url(url: Column, paths: Sequence[str], patterns: Sequence[str]) -> Column:
    """URL-02: substrings (whatever case) or patterns of the path; query strings are never looked at."""
    p = path(url)
    found = any_of([F.lower(p).contains(s) for s in paths])
    return found | p.rlike("|".join(f"(?:{x})" for x in patterns)) if patterns else found


def glob_regex(globs: Sequence[str]) -> str:
    """One anchored pattern for shell globs, in which * and ? also match a slash."""
    return "(?s)^(?:" + "|".join("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g.lower()) for g in globs) + ")$"


def path_allowed(url: Column, extensions: Sequence[str] = (), blocked: Sequence[str] = (), allowed: Sequence[str] = ()) -> Column:
    """URL-03: no skipped extension, no blocked glob, and an allowed glob if there are any."""
    p = F.lower(path(url))
    ok = ~any_of([p.endswith(e) for e in extensions])
    if blocked:
        ok = ok & ~p.rlike(glob_regex(blocked))
    return ok & p.rlike(glob_regex(allowed)) if allowed else ok


def url_priority(url: Column) -> Column:
    """URL-04: one for each term that the URL contains, two more for a PDF."""
    low = F.lower(url)
    score = F.when(low.endswith(".pdf"), 2).otherwise(0)
    for term in PRIORITY_TERMS:
        score = score + low.contains(term).cast("int")
    return score


def denial_reason(status_code: Column, server: Column, body: Column) -> Column:
    """URL-10: why a response was denied, from its server header or the first 2000 characters."""
    text, host = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 2000)), F.lower(F.coalesce(server, F.lit("")))
    start = F.concat(F.lit("HTTP "), status_code.cast("string"))
    reason = F.coalesce(*(F.when(host.contains(k), v) for k, v in DENIALS[:2]), *(F.when(text.contains(k), v) for k, v in DENIALS))
    return F.when(reason.isNull(), start).otherwise(F.concat(start, F.lit(" -- "), reason))


def response_status(status_code: Column) -> Column:
    return F.when(status_code == 403, "access_denied").when(status_code == 404, "not_found").when(status_code == 429, "rate_limited").when(status_code >= 400, "unknown_error").otherwise("success")


def looks_like_pdf(url: Column, content_type: Column) -> Column:
    """URL-12."""
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("application/pdf") | F.lower(path(url)).endswith(".pdf")


def region_suffix(host: Column) -> Column:
    """The longest known suffix of a host, or null."""
    h = bare_host(host)
    return F.coalesce(*(F.when(h.endswith(s) | (h == s[1:]), s) for s in sorted(SUFFIX_REGIONS, key=len, reverse=True)))


def detect_region(host: Column) -> Column:
    """URL-13: region tags by the longest suffix; a third-level .gov host names its state."""
    h, suffix = bare_host(host), region_suffix(host)
    parts = F.split(h, r"\.")
    state = F.regexp_replace(F.element_at(parts, -2), "-", "_")
    none = F.array().cast("array<string>")
    gov = F.when((F.size(parts) >= 3) & h.endswith(".gov"), F.array(F.lit("us"), F.lit("us_states"), state)).otherwise(F.array(F.lit("us")))
    tags = F.create_map(*(x for k, v in SUFFIX_REGIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else none)))
    return F.when(F.coalesce(host, F.lit("")) == "", none).when(suffix.isNull(), none).when(suffix == ".gov", gov).otherwise(tags[suffix])


def domain_id(host: Column) -> Column:
    """URL-14: a stable id of at most 30 characters."""
    h, suffix = bare_host(host), region_suffix(host)
    parts = F.split(h, r"\.")
    short = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    state = F.element_at(parts, -2)
    agency = F.when(F.size(parts) == 3, F.get(parts, F.lit(0))).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "_"))
    tidy = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[.-]", "_"), "_+", "_"), "^_+|_+$", "")
    front = F.substring(h, F.lit(1), F.length(h) - F.length(suffix))
    uk = F.regexp_replace(F.regexp_replace(front, r"\.", "_"), "^_+|_+$", "")
    out = (
        F.when((suffix == ".gov") & (F.size(parts) >= 3), F.concat(F.coalesce(short[state], F.substring(state, 1, 2)), F.lit("_"), agency))
        .when((suffix == ".gov") & (F.size(parts) == 2), F.concat(F.lit("us_"), F.get(parts, F.lit(0))))
        .when(suffix == ".gov.uk", F.concat(F.lit("uk_"), F.when((h == "gov.uk") | (uk == ""), "gov").otherwise(uk)))
        .when(suffix.isNotNull() & (suffix != ".gov"), tidy(F.when(F.length(h) <= F.length(suffix), F.regexp_replace(suffix, "[.-]", "")).otherwise(front)))
        .otherwise(tidy(h))
    )
    return F.substring(out, 1, 30)


def is_public_url(url: Column) -> Column:
    """URL-15: http(s), a host, and no IPv4 or IPv6 literal of a private, local, reserved or multicast range.

    Names aren't looked up.
    """
    host = F.regexp_replace(F.lower(F.regexp_replace(netloc(url), r"^[^@]*@", "")), r":\d*$", "")
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    literal = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b, c = (F.get(octets, F.lit(i)) for i in range(3))
    private = (
        a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
    six = host.rlike(r"^\[.*\]$")
    local6 = host.rlike(r"^\[(::1?|0*(:0*)*:0*1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|ff[0-9a-f]{2}:.*|2001:0?db8:.*|::ffff:.*)\]$")
    return scheme(url).isin("http", "https") & (host != "") & ~(literal & private) & ~(six & local6)


def url_bonus(url: Column, gov_suffixes: Sequence[str], gov: float, law_paths: Sequence[str], law: float, number: str, bonus: float) -> Column:
    """KW-05: one bonus each for a government host, a law-like path and a bill number."""
    host, q = F.lower(netloc(url)), query(url)
    full = F.when(q != "", F.concat(F.lower(path(url)), F.lit("?"), q)).otherwise(F.lower(path(url)))
    laws = "(?i)" + "|".join(f"(?:{p})" for p in law_paths)
    part = lambda hit, x: F.when(hit, F.lit(float(x))).otherwise(F.lit(0.0))
    return part(any_of([host.endswith(s) for s in gov_suffixes]), gov) + part(full.rlike(laws), law) + part(full.rlike("(?i)" + number), bonus)
