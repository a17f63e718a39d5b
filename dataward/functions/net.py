"""Network addresses and public links: address classes, blocked links, stable public URLs."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.barrier import once
from dataward.functions.sensitive import sensitive_folded
from dataward.functions.unicode import folded as folded_text

# Special-purpose address blocks (prefix, globally reachable) of the public registries,
# the extra blocks that may not appear in links, and the allocated global unicast blocks.
IPV4_BLOCKS = (
    ("0.0.0.0/32", False), ("0.0.0.0/8", False), ("10.0.0.0/8", False), ("100.64.0.0/10", False), ("127.0.0.0/8", False),
    ("169.254.0.0/16", False), ("172.16.0.0/12", False), ("192.0.0.0/24", False), ("192.0.0.0/29", False), ("192.0.0.8/32", False),
    ("192.0.0.9/32", True), ("192.0.0.10/32", True), ("192.0.0.170/32", False), ("192.0.0.171/32", False), ("192.0.2.0/24", False),
    ("192.31.196.0/24", True), ("192.52.193.0/24", True), ("192.88.99.0/24", False), ("192.88.99.2/32", False), ("192.168.0.0/16", False),
    ("192.175.48.0/24", True), ("198.18.0.0/15", False), ("198.51.100.0/24", False), ("203.0.113.0/24", False), ("224.0.0.0/4", False),
    ("240.0.0.0/4", False), ("255.255.255.255/32", False))
IPV6_BLOCKS = (
    ("::/128", False), ("::1/128", False), ("::ffff:0:0/96", False), ("64:ff9b::/96", True), ("64:ff9b:1::/48", False), ("100::/64", False),
    ("100:0:0:1::/64", False), ("2001::/23", False), ("2001::/32", False), ("2001:1::1/128", True), ("2001:1::2/128", True), ("2001:1::3/128", True),
    ("2001:2::/48", False), ("2001:3::/32", True), ("2001:4:112::/48", True), ("2001:10::/28", False), ("2001:20::/28", True), ("2001:30::/28", True),
    ("2001:db8::/32", False), ("2002::/16", False), ("2620:4f:8000::/48", True), ("3fff::/20", False), ("5f00::/16", False), ("fc00::/7", False),
    ("fe80::/10", False), ("fec0::/10", False))
IPV6_ALLOCATED = (
    "2001::/23", "2001:200::/23", "2001:400::/23", "2001:600::/23", "2001:800::/22", "2001:c00::/23", "2001:e00::/23", "2001:1200::/23",
    "2001:1400::/22", "2001:1800::/23", "2001:1a00::/23", "2001:1c00::/22", "2001:2000::/19", "2001:4000::/23", "2001:4200::/23", "2001:4400::/23",
    "2001:4600::/23", "2001:4800::/23", "2001:4a00::/23", "2001:4c00::/23", "2001:5000::/20", "2001:8000::/19", "2001:a000::/20", "2001:b000::/20",
    "2002::/16", "2003::/18", "2400::/12", "2410::/12", "2600::/12", "2610::/23", "2620::/23", "2630::/12", "2800::/12", "2a00::/12", "2a10::/12", "2c00::/12")
NAT64 = "64:ff9b::/96"
SENSITIVE_QUERY_KEY = (r"(?i)^(?:access[-_]?token|api[-_]?key|credential|password|secret|sig(?:nature)?|token|x-amz-.+|x-goog-.+)$")
LOCAL_NAMES = ("localhost", "home.arpa", "test", "example", "corp", "lan", "home", "onion")
LOCAL_SUFFIXES = (".localhost", ".home.arpa", ".test", ".example", ".corp", ".lan", ".home", ".internal", ".invalid", ".local", ".onion")
STABLE_PREDICATES = (
    "http://www.w3.org/ns/dcat#accessURL", "http://www.w3.org/ns/dcat#downloadURL", "http://www.w3.org/ns/dcat#endpointDescription",
    "http://www.w3.org/ns/dcat#endpointURL", "http://www.w3.org/ns/dcat#landingPage", "http://xmlns.com/foaf/0.1/homepage")
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|0?\d?\d|00\d)"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_number(host: Column) -> Column:
    """A dotted address as a number, NULL when it is none."""
    parts = [F.regexp_extract(host, IPV4, i).try_cast("bigint") for i in range(1, 5)]
    total = parts[0]
    for p in parts[1:]:
        total = total * 256 + p
    return F.when(host.rlike(IPV4), total)


def _longest(blocks, match) -> Column:
    """Verdict of the most specific block that matches; the list is fixed, so no join is needed."""
    out = F.lit(None).cast("boolean")
    for prefix, reachable in sorted(blocks, key=lambda b: ipaddress.ip_network(b[0]).prefixlen):
        out = F.when(match(ipaddress.ip_network(prefix)), F.lit(reachable)).otherwise(out)
    return out


def ipv4_global(number: Column) -> Column:
    verdict = _longest(IPV4_BLOCKS, lambda n: number.between(int(n.network_address), int(n.broadcast_address)))
    return F.when(number.isNotNull(), F.coalesce(verdict, F.lit(True)))


def ipv6_hex(host: Column) -> Column:
    """An IPv6 address as 32 hex digits, NULL when malformed; an embedded dotted tail is accepted."""
    text = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
    dotted = F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    tail = F.lpad(F.lower(F.hex(F.coalesce(ipv4_number(dotted), F.lit(0)))), 8, "0")
    text = F.when((dotted != "") & ipv4_number(dotted).isNotNull(), F.concat(
        F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(text)
    halves = F.split(text, "::")
    words = lambda h: F.filter(F.split(h, ":"), lambda w: w != "")
    head, rest = words(halves[0]), F.when(F.size(halves) == 2, words(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    gap = 8 - F.size(head) - F.size(rest)
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), rest)
    ok = (text.rlike(r"^[0-9a-f:]+$") & F.contains(text, F.lit(":")) & (F.size(halves) <= 2) & ~F.contains(text, F.lit(":::"))
          & F.forall(full, lambda w: F.length(w) <= 4) & (F.size(full) == 8)
          & F.when(F.size(halves) == 2, gap >= 1).otherwise((gap == 0) & ~text.startswith(":") & ~text.endswith(":")))
    return F.when(F.coalesce(ok, F.lit(False)), F.array_join(F.transform(full, lambda w: F.lpad(w, 4, "0")), ""))


def _in_block(hexes: Column, network) -> Column:
    lo, hi = f"{int(network.network_address):032x}", f"{int(network.broadcast_address):032x}"
    return hexes.between(lo, hi)


def ipv6_global(hexes: Column) -> Column:
    """Reachability by the most specific special block; NAT64 asks the embedded IPv4 address; other
    addresses must lie in allocated unicast space."""
    embedded = F.conv(F.substring(hexes, 25, 8), 16, 10).cast("bigint")
    special = _longest(IPV6_BLOCKS, lambda n: _in_block(hexes, n))
    allocated = F.lit(False)
    for prefix in IPV6_ALLOCATED:
        allocated = allocated | _in_block(hexes, ipaddress.ip_network(prefix))
    return F.when(hexes.isNotNull(), F.when(_in_block(hexes, ipaddress.ip_network(NAT64)), ipv4_global(embedded)).otherwise(F.coalesce(special, allocated)))


def ip_class(df: DataFrame, host_col: str) -> DataFrame:
    """Add address_family (4, 6 or NULL) and is_global for a host column."""
    host = F.col(host_col)
    v6 = F.contains(host, F.lit(":"))
    numbers = once(df, {"_v4": ipv4_number(host), "_v6": F.when(v6, ipv6_hex(host))})
    return once(numbers, {
        "address_family": F.when(F.col("_v4").isNotNull(), 4).when(v6, 6),
        "is_global": F.when(F.col("_v4").isNotNull(), ipv4_global(F.col("_v4"))).when(v6, F.coalesce(ipv6_global(F.col("_v6")), F.lit(False)))}).drop("_v4", "_v6")


def decoded(col: Column) -> Column:
    """Percent-decoding until nothing changes, at most three times; NULL when malformed."""
    plus = lambda c: F.regexp_replace(c, r"\+", "%2B")
    out = col
    for _ in range(3):
        out = F.try_url_decode(plus(out))
    return out


def host_of(col: Column) -> Column:
    raw = F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:\[\]@]*)(?::\d*)?(?:[/?#]|$)", 1)
    return F.regexp_replace(F.lower(raw), r"[.]$", "")


def blocked_iri_reason(df: DataFrame, iri_col: str, out: str = "blocked_reason") -> DataFrame:
    """Add why an HTTP(S) link must not be public: user info, secrets, bad encoding, local host.

    Unicode folding of query, path and fragment happens in one Arrow call per row.
    """
    iri = F.col(iri_col)
    query = F.regexp_extract(iri, r"\?([^#]*)", 1)
    parts = once(df, {
        "_pairs": F.filter(F.split(query, "&"), lambda p: p != ""), "_fragment": F.regexp_extract(iri, r"(#.*)$", 1),
        "_path": F.regexp_extract(iri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "_host": F.regexp_replace(host_of(iri), r"^\[|\]$", "")})
    name = lambda p: F.split(p, "=", 2)[0]
    plain = once(parts, {
        "_names": F.transform("_pairs", lambda p: F.coalesce(F.try_url_decode(name(p)), name(p))),
        "_raw": F.transform("_pairs", lambda p: F.coalesce(F.try_url_decode(F.get(F.split(p, "=", 2), F.lit(1))), F.lit(""))),
        "_dpath": decoded(F.col("_path")), "_dfragment": decoded(F.col("_fragment"))})
    again = once(plain, {"_deep": F.transform("_raw", decoded)})
    folded = ip_class(once(again, {
        "_values": folded_text(F.concat_ws("\n", "_raw", "_deep")),
        "_parts": folded_text(F.concat_ws("\n", "_path", "_fragment", "_dpath", "_dfragment"))}), "_host")
    sensitive = lambda c: sensitive_folded(F.col(c))
    host = F.col("_host")
    local = (~F.contains(host, F.lit(".")) & ~F.contains(host, F.lit(":"))) | host.isin(*LOCAL_NAMES)
    for s in LOCAL_SUFFIXES:
        local = local | host.endswith(s)
    reason = (F.when(~F.coalesce(iri.rlike(r"(?i)^https?:"), F.lit(False)), None).when((host == "") | iri.rlike(r"\s"), "invalid-http-iri")
              .when(iri.rlike(r"^[^/]*//[^/?#]*@"), "userinfo").when(F.exists("_names", lambda n: n.rlike(SENSITIVE_QUERY_KEY)), "sensitive-query")
              .when(F.exists("_deep", lambda v: v.isNull()), "invalid-url-encoding").when(sensitive("_values"), "sensitive-query-value")
              .when(F.col("_dpath").isNull() | F.col("_dfragment").isNull(), "invalid-url-encoding").when(sensitive("_parts"), "sensitive-url-component")
              .when(local | ~F.coalesce(F.col("is_global"), F.lit(True)), "non-global-host"))
    return once(folded, {out: reason}).select(*df.columns, out)


def unstable_url_reason(predicate: Column, value: Column, hosts: list[str]) -> Column:
    """Why an access URL is not stable: scheme, query or fragment, or a host off the short list."""
    return F.when(predicate.isin(*STABLE_PREDICATES), F.when(~value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), "invalid-public-url")
                  .when(~F.lower(value).startswith("https:"), "non-https-public-url").when(value.rlike(r"[?#]."), "query-or-fragment")
                  .when(~host_of(value).isin(hosts), "unapproved-public-host"))


def approved_host(value: Column, hosts: list[str]) -> Column:
    """HTTP links must name an approved DNS host; addresses are never approved. Other schemes pass."""
    host = host_of(value)
    address = ipv4_number(host).isNotNull() | F.contains(host, F.lit(":"))
    return F.when(value.rlike(r"(?i)^https?:"), ~address & host.isin(hosts)).otherwise(True)
