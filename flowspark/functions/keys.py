"""Flow identity and protocol naming (all Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.schemas import TCP_FLAGS

# fixed values: protocol names
FLOW_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPV6"}
ECS_PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 51: "ah"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _key(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    return F.concat(src, F.lit(":"), sport, F.lit("->"), dst, F.lit(":"), dport, F.lit("/"), proto)


def directed_key(src="src_ip", sport="src_port", dst="dst_ip", dport="dst_port", proto="protocol") -> Column:
    """``src:sp->dst:dp/proto``; null when any part is null."""
    return _key(col(src), col(sport), col(dst), col(dport), col(proto))


def reverse_key(src="src_ip", sport="src_port", dst="dst_ip", dport="dst_port", proto="protocol") -> Column:
    """The directed key of the opposite direction."""
    return _key(col(dst), col(dport), col(src), col(sport), col(proto))


CANONICAL = ("ip1", "ip2", "port1", "port2", "protocol")


def canonical_flow(df: DataFrame) -> DataFrame:
    """Add the direction-free endpoints. Equal addresses always swap, ports follow the address."""
    keep = F.col("src_ip") < F.col("dst_ip")

    def pick(a: str, b: str) -> Column:
        return F.when(keep, F.col(a)).otherwise(F.col(b))

    return df.withColumns(
        {
            "ip1": pick("src_ip", "dst_ip"),
            "ip2": pick("dst_ip", "src_ip"),
            "port1": pick("src_port", "dst_port"),
            "port2": pick("dst_port", "src_port"),
        }
    )


def flow_id() -> Column:
    """``ip1:port1-ip2:port2-proto`` of the canonical columns."""
    return F.concat(
        F.col("ip1"), F.lit(":"), F.col("port1"), F.lit("-"),
        F.col("ip2"), F.lit(":"), F.col("port2"), F.lit("-"), F.col("protocol"),
    )


def is_forward() -> Column:
    """The packet travels from the first canonical endpoint to the second."""
    return (F.col("src_ip") == F.col("ip1")) & (F.col("src_port") == F.col("port1"))


def protocol_name(c: str | Column, style: str = "flow") -> Column:
    """Protocol number to name; unknown numbers stay as digits, null stays null."""
    names = FLOW_PROTOCOLS if style == "flow" else ECS_PROTOCOLS
    value = col(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for number, name in names.items():
        out = out.when(value == number, name)
    return out.otherwise(value.cast("string"))


def tcp_flag_names(c: str | Column) -> Column:
    """Flag bitmask to the ordered array of names."""
    value = col(c).cast("int")
    return F.array_compact(
        F.array(*[F.when(value.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in TCP_FLAGS])
    )


def strip_mapped_ipv4(c: str | Column) -> Column:
    """Drop the ``::ffff:`` prefix of an IPv4-mapped IPv6 address."""
    return F.regexp_replace(col(c), "^::ffff:", "")


def ipv4_to_long(c: str | Column) -> Column:
    """Dotted IPv4 to its number; anything else is null."""
    parts = F.split(col(c), r"\.")
    octets = [F.expr("1").cast("long") * F.try_to_number(F.get(parts, F.lit(i)), F.lit("999")).cast("long") for i in range(4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    whole = F.forall(F.array(*octets), lambda o: o <= 255)
    return F.when(col(c).rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & whole, number)


def ipv6_groups(c: str | Column) -> Column:
    """The eight 16-bit groups of an IPv6 address as numbers; anything else is null.

    ``::`` stands for as many zero groups as are missing. Zone names and dotted tails are not read.
    """
    text = F.lower(col(c))
    halves = F.split(text, "::")
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: F.length(g) > 0)
    head = groups(F.get(halves, F.lit(0)))
    tail = F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(head) - F.size(tail)
    filled = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    form = text.rlike("^[0-9a-f:]+$") & ~text.rlike(":::|[0-9a-f]{5}|^:[^:]|[^:]:$") & (F.size(halves) <= 2)
    sized = F.when(F.size(halves) == 2, missing >= 1).otherwise(missing == 0)
    return F.when(form & sized, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("long")))


def ip_prefix(c: str | Column, length: Column) -> Column:
    """The first ``length`` bits of an address as text (``4:`` or ``6:`` and hexadecimal); null where it isn't one."""
    v4, v6 = ipv4_to_long(c), ipv6_groups(c)
    low = F.floor(v4 / F.pow(F.lit(2.0), 32 - length)).cast("long")
    cut = F.transform(v6, lambda g, i: F.floor(g / F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(F.lit(16), 16 * (i + 1) - length)))).cast("long"))
    packed = F.array_join(F.transform(cut, lambda g: F.hex(g)), ":")
    return F.when(v4.isNotNull() & length.between(0, 32), F.concat(F.lit("4:"), F.hex(low))).when(
        v6.isNotNull() & length.between(0, 128), F.concat(F.lit("6:"), packed)
    )


def long_to_ipv4(c: Column) -> Column:
    """Number to dotted IPv4."""
    return F.concat_ws(
        ".", *[F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )


def be_uint(data: Column, pos: Column | int, width: int) -> Column:
    """Big-endian unsigned integer of ``width`` bytes at 1-based ``pos``; null past the end."""
    start = pos if isinstance(pos, Column) else F.lit(pos)
    piece = F.substring(data, start, F.lit(width))
    return F.when(
        F.octet_length(piece) == width, F.conv(F.hex(piece), 16, 10).cast("long")
    )


def be_ipv4(data: Column, pos: Column | int) -> Column:
    return long_to_ipv4(be_uint(data, pos, 4))
