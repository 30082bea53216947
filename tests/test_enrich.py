"""Networks and as-of lookups against brute force, with hot keys."""

import ipaddress
import random

from pyspark.sql import functions as F

from vigilog.functions.net import ip_bits
from vigilog.operators.enrich import _blocks, enrich_as_of, enrich_by_network


def number(ip):
    return int(ipaddress.ip_address(ip))


def test_bits_of_addresses(spark):
    ips = ["1.2.3.4", "255.255.255.255", "::", "::1", "2001:db8::", "2001:DB8::ff:0:1", "1:2:3:4:5:6:7:8", "fe80::1:2", "1::8", "a:b:c:d:e:f::", "::b:c:d:e:f:1"]
    got = {r.ip: r.b for r in spark.createDataFrame([(i,) for i in [*ips, "x", "1.2.3", "", ":::"]], "ip string").select(
        "ip", ip_bits(F.col("ip")).alias("b")).collect()}
    for ip in ips:
        a = ipaddress.ip_address(ip)
        assert got[ip] == str(a.version) + format(int(a), f"0{a.max_prefixlen}b"), ip
    assert all(got[x] is None for x in ["x", "1.2.3", "", ":::"])


def test_narrowest_range(spark):
    rng = random.Random(3)
    nets = [(0, 2**32 - 1), (7, 7), (0, 0), (2**32 - 1, 2**32 - 1)]
    for _ in range(120):
        lo = rng.randrange(2**32 - 70_000)
        nets.append((lo, lo + rng.choice([0, 1, 2, 5, 255, 1000, 65535, 69_999])))
    ips = {str(ipaddress.ip_address(min(max(x + d, 0), 2**32 - 1))) for lo, hi in nets for x in (lo, hi, (lo + hi) // 2) for d in (-1, 0, 1)}
    got = enrich_by_network(spark.createDataFrame([(i,) for i in [*ips, "junk", None]], "ip string"),
                            spark.createDataFrame(nets, "ip_lo bigint, ip_hi bigint")).collect()
    for r in got:
        own = [(hi - lo, lo, hi) for lo, hi in nets if r.ip in ips and lo <= number(r.ip) <= hi]
        assert (r.ip_lo, r.ip_hi) == (min(own)[1:] if own else (None, None))
    assert len(got) == len(ips) + 2


def test_ipv6_and_ipv4_networks(spark):
    nets = ["2001:db8::/32", "2001:db8:1::/48", "2001:db8:1::7/128", "::/0", "10.0.0.0/8", "10.1.0.0/16", "fe80::/10", "bad/9", "10.0.0.0/40"]
    ips = ["2001:db8::1", "2001:db8:1:2::", "2001:db8:1::7", "9::9", "10.1.2.3", "10.2.2.3", "11.0.0.1", "febf::1", "fec0::1"]
    got = {r.ip: r.cidr for r in enrich_by_network(spark.createDataFrame([(i,) for i in ips], "ip string"),
                                                   spark.createDataFrame([(n,) for n in nets], "cidr string")).collect()}
    for ip in ips:
        own = [n for n in nets[:7] if ipaddress.ip_address(ip) in ipaddress.ip_network(n)]
        assert got[ip] == max(own, key=lambda n: int(n.split("/")[1]), default=None), ip


def test_a_dense_network_gives_as_many_pairs_as_hits(spark):
    lo = number("10.7.0.0")
    nets = spark.range(65536).selectExpr(f"id + {lo} as ip_lo", f"id + {lo} as ip_hi")
    assert _blocks(nets).count() == 65536
    ips = spark.range(2000).selectExpr("concat('10.7.', id div 250, '.', id % 250) as ip")
    asked = ips.select(F.substring(ip_bits(F.col("ip")), 1, 33).alias("_prefix"))
    assert asked.join(_blocks(nets), "_prefix").count() == 2000
    assert enrich_by_network(ips, nets).where("ip_lo = ip_hi").count() == 2000


def test_as_of_a_hot_address(spark):
    rng = random.Random(6)
    ttl = 50
    seen = [(rng.choice(["hot", "hot", "hot", "b"]), rng.randint(0, 400) * 1_000_000, f"l{i}") for i in range(300)]
    asked = [(i, rng.choice(["hot", "hot", "b", "c"]), rng.randint(0, 500) * 1_000_000) for i in range(300)] + [(300, None, 5), (301, "hot", None)]
    got = enrich_as_of(spark.createDataFrame(asked, "id int, ip string, us bigint"),
                       spark.createDataFrame(seen, "ip string, enriched_us bigint, lookup string"), "ip", "us", ttl).collect()
    assert len(got) == len(asked)
    for r in got:
        own = [(t, name) for ip, t, name in seen if ip == r.ip and r.us is not None and t <= r.us and r.us - t < ttl * 1_000_000]
        newest = max((t for t, _ in own), default=None)
        assert r.enriched_us == newest and (newest is None or r.lookup in {n for t, n in own if t == newest})
