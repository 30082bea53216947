"""IP addresses as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog.functions.text import any_of, whole_number
from vigilog.values import PORT_BUCKETS

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
IPV6 = (
    r"(?i)^(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$)"
    r"(?!.*::.*::)(?!.*:::)(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::"
    r"(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)$"
)
# Networks that are never looked up (first, last address as numbers).
PRIVATE_NETS = [
    ("10.0.0.0", "10.255.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
]


def _number(text: str) -> int:
    a, b, c, d = (int(p) for p in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def is_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4) | ip.rlike(IPV6), F.lit(False))


def ip_number(ip: Column) -> Column:
    """IPv4 text to its 32-bit number, null for anything else."""
    p = F.split(ip, r"\.")
    total = whole_number(F.get(p, F.lit(0)), "bigint")
    for i in (1, 2, 3):
        total = total * 256 + whole_number(F.get(p, F.lit(i)), "bigint")
    return F.when(is_ipv4(ip), total)


def ip_bits(ip: Column) -> Column:
    """An address as text of its family (4 or 6) and its 32 or 128 bits, null for anything else."""
    # the groups that :: stands for are written out
    missing = 8 - F.length(F.regexp_replace(ip, "[^:]", ""))
    inside = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.greatest(missing, F.lit(0))))
    full = F.when(F.contains(ip, F.lit("::")), F.concat(
        F.when(F.startswith(ip, F.lit("::")), F.lit("0")).otherwise(F.lit("")),
        F.replace(ip, F.lit("::"), inside),
        F.when(F.endswith(ip, F.lit("::")), F.lit("0")).otherwise(F.lit("")))).otherwise(ip)
    groups = F.transform(F.split(full, ":"), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0"))
    return F.when(is_ipv4(ip), F.concat(F.lit("4"), F.lpad(F.bin(ip_number(ip)), 32, "0"))).when(
        F.coalesce(ip.rlike(IPV6), F.lit(False)), F.concat(F.lit("6"), F.array_join(groups, "")))


def is_private(ip: Column) -> Column:
    """Private, loopback or link-local; text that is no address is not private."""
    number = ip_number(ip)
    return F.coalesce(
        any_of([number.between(_number(a), _number(b)) for a, b in PRIVATE_NETS]), F.lit(False)
    ) | F.coalesce(
        ip.rlike(IPV6) & ip.rlike(r"(?i)^(?:::1|(?:0{1,4}:){7}0{0,3}1|f[cd][0-9a-f]{2}:.*)$"),
        F.lit(False))


def is_rfc1918(ip: Column) -> Column:
    """Four whole numbers that begin as 10, 172.16-31 or 192.168 do."""
    p = F.split(ip, r"\.")
    n = [whole_number(F.get(p, F.lit(i))) for i in range(4)]
    shape = (F.size(p) == 4) & n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull() & \
        n[3].isNotNull()
    return F.coalesce(
        shape & ((n[0] == 10) | ((n[0] == 172) & n[1].between(16, 31))
                 | ((n[0] == 192) & (n[1] == 168))), F.lit(False))


def port_bucket(port: Column) -> Column:
    ladder = F.when(port <= PORT_BUCKETS[0][0], F.lit(PORT_BUCKETS[0][1]))
    for upto, value in PORT_BUCKETS[1:]:
        ladder = ladder.when(port <= upto, F.lit(value))
    return ladder.otherwise(F.lit(0.9))
