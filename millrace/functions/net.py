"""Network address and DNS name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.let import let

_QUAD = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
_G = r"[0-9a-fA-F]{1,4}"
IPV6_FORMS = [
    rf"^({_G}:){{7}}{_G}$",
    rf"^({_G}:){{6}}{_QUAD}$",
    rf"^(({_G}:){{0,6}}{_G})?::(({_G}:){{0,6}}{_G})?$",
    rf"^(({_G}:){{0,4}}{_G})?::(({_G}:){{0,5}})?{_QUAD}$",
]


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(rf"^{_QUAD}$") & F.forall(F.split(ip, r"\."), lambda o: o.try_cast("int") <= 255)


def is_ipv6(ip: Column) -> Column:
    found = ip.rlike(IPV6_FORMS[0])
    for form in IPV6_FORMS[1:]:
        found = found | ip.rlike(form)
    return found


def is_valid_ip(ip: Column) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def ip_to_long(ip: Column) -> Column:
    """Number of a dotted quad, null when it is none."""
    number = F.aggregate(
        F.split(ip, r"\."), F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + F.coalesce(o.try_cast("bigint"), F.lit(0))
    )
    return F.when(is_ipv4(ip), number)


def long_to_ip(number: Column) -> Column:
    octets = [F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def net_range(entry: Column) -> Column:
    """struct(lo, hi) of ``a.b.c.d/bits`` or ``a.b.c.d/mask``, null for anything else."""
    bits = F.regexp_extract(entry, rf"^{_QUAD}/([0-9]{{1,2}})$", 1).try_cast("int")
    # bits below the mask span the range
    spans = F.expr("map(" + ", ".join(f"{n}, {2 ** (32 - n) - 1}L" for n in range(33)) + ")")
    mask = ip_to_long(F.regexp_extract(entry, rf"^{_QUAD}/({_QUAD})$", 1))
    span = F.coalesce(F.try_element_at(spans, bits), F.lit(4294967295) - mask)
    parts = F.struct(ip_to_long(F.regexp_extract(entry, rf"^({_QUAD})/", 1)).alias("base"), span.alias("span"))

    def limits(p: Column) -> Column:
        lo = p["base"].bitwiseAND(F.lit(4294967295) - p["span"])
        return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), (lo + p["span"]).alias("hi")))

    return let(parts, limits)


def expand_ipv6(ip: Column) -> Column:
    """``::`` filled up with zero groups; addresses without it are kept."""

    def fill(parts: Column) -> Column:
        def groups(side: Column) -> Column:
            return F.when(side == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(side, ":"))

        head, tail = groups(F.get(parts, F.lit(0))), groups(F.get(parts, F.lit(1)))
        # an embedded IPv4 tail takes the place of two groups
        width = F.size(head) + F.size(tail) + F.when(F.contains(F.get(parts, F.lit(1)), F.lit(".")), 1).otherwise(0)
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - width, F.lit(0)))
        return F.array_join(F.concat(head, zeros, tail), ":")

    return F.when(F.contains(ip, F.lit("::")), let(F.split(ip, "::"), fill)).otherwise(ip)


def reverse_name(ip: Column) -> Column:
    """Reverse-map domain name of an address."""
    v4 = F.concat(F.array_join(F.reverse(F.split(ip, r"\.")), "."), F.lit(".in-addr.arpa."))
    nibbles = F.array_join(F.transform(F.split(expand_ipv6(ip), ":"), lambda g: F.lpad(F.lower(g), 4, "0")), "")
    v6 = F.concat(F.array_join(F.split(F.reverse(nibbles), "(?!^)(?!$)"), "."), F.lit(".ip6.arpa."))
    return F.when(is_ipv4(ip), v4).when(is_ipv6(ip) & ~F.contains(ip, F.lit(".")), v6)


def reverse_addr(name: Column) -> Column:
    """Address of a reverse-map name (IPv6 in full form), null for other names."""
    labels = F.split(F.regexp_extract(F.lower(name), r"^(.*)\.in-addr\.arpa\.?$", 1), r"\.")
    v4 = F.array_join(F.reverse(labels), ".")
    nibbles = F.reverse(F.replace(F.regexp_extract(F.lower(name), r"^(.*)\.ip6\.arpa\.?$", 1), F.lit("."), F.lit("")))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: nibbles.substr(i * 4 + 1, F.lit(4)))
    v6 = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":")
    return F.when(name.rlike(r"(?i)\.in-addr\.arpa\.?$") & is_ipv4(v4), v4).when(
        name.rlike(r"(?i)\.ip6\.arpa\.?$") & (F.length(nibbles) == 32), v6
    )


# Seconds of each unit.
TTL_UNITS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}


def ttl_seconds(text: Column) -> Column:
    """Seconds of a plain number or of ``1w6d4h3m10s``; null when malformed or out of range."""

    def part(item: Column) -> Column:
        number = F.regexp_extract(item, r"^([0-9]+)", 1).try_cast("bigint")
        factor = F.lit(None).cast("bigint")
        for unit, seconds in TTL_UNITS.items():
            factor = F.when(F.lower(F.substring(item, -1, 1)) == unit, seconds).otherwise(factor)
        return F.coalesce(number, F.lit(0)) * factor

    items = F.regexp_extract_all(text, F.lit("[0-9]*[wdhmsWDHMS]"), F.lit(0))
    summed = F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, i: acc + part(i))
    total = F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("bigint")).when(
        text.rlike("^[0-9]{1,10}[wdhmsWDHMS]([0-9]{0,10}[wdhmsWDHMS])*$"), summed
    )
    return F.when(total.between(0, 2147483647), total)


def name_labels(name: Column) -> Column:
    """Lower-cased labels from the root down; a trailing dot is the root label."""
    return F.reverse(F.split(F.lower(name), r"\."))


def name_relation(a: Column, b: Column) -> Column:
    """struct(relation, shared): how name ``a`` relates to ``b`` and how many labels they share."""

    def compare(pair: Column) -> Column:
        la, lb = pair["a"], pair["b"]
        equal = F.transform(
            F.sequence(F.lit(0), F.least(F.size(la), F.size(lb)) - 1), lambda i: F.get(la, i) == F.get(lb, i)
        )
        differs = F.array_position(equal, F.lit(False)).cast("int")
        shared = F.when(differs == 0, F.size(equal)).otherwise(differs - 1)
        relation = (
            F.when(F.endswith(a, F.lit(".")) != F.endswith(b, F.lit(".")), "none")
            .when(differs > 0, F.when(shared > 0, "common").otherwise("none"))
            .when(F.size(la) < F.size(lb), "super")
            .when(F.size(la) > F.size(lb), "sub")
            .otherwise("equal")
        )
        both = F.endswith(a, F.lit(".")) == F.endswith(b, F.lit("."))
        return F.struct(relation.alias("relation"), F.when(both, shared).otherwise(0).alias("shared"))

    return let(F.struct(name_labels(a).alias("a"), name_labels(b).alias("b")), compare)


def name_suffixes(name: Column) -> Column:
    """The name and all its parents, longest first."""
    labels = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def clean_host(host: Column) -> Column:
    """Host name without blanks and repeated dots."""
    return F.regexp_replace(F.regexp_replace(host, r"\s+", ""), r"\.\.+", ".")
