"""Attributes of IP addresses joined to events or alerts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.net import ip_bits, is_ip, is_private
from vigilog.functions.severity import abuse_labels, risk_level
from vigilog.session import checkpointed
from vigilog.values import ENRICH_TTL_SECONDS

GEO = ["country", "country_code", "region", "city", "latitude", "longitude", "isp", "org", "asn",
       "is_proxy", "is_hosting"]
ABUSE = ["abuse_score", "abuse_reports", "abuse_category_ids"]


def _verdict(rows: DataFrame) -> DataFrame:
    """Adds what follows from the joined attributes; private and invalid addresses have none."""
    usable = F.col("_known") & ~F.col("is_private") & F.col("_valid")
    present = [c for c in GEO + ABUSE if c in rows.columns]
    rows = rows.select(
        *[c for c in rows.columns if c not in present],
        *[F.when(usable, F.col(c)).alias(c) for c in present])
    rows = rows.withColumn(
        "error",
        F.when(~F.col("_valid"), "Invalid IP address")
        .when(~F.col("_known") & ~F.col("is_private"), "No enrichment data"),
    )
    if "abuse_score" in rows.columns:
        rows = rows.withColumn("risk_level", risk_level(F.col("is_private"), F.col("abuse_score")))
    if "abuse_category_ids" in rows.columns:
        rows = rows.withColumn("abuse_categories", abuse_labels("abuse_category_ids"))
    return rows.drop("_known", "_valid")


def enrich_ips(ips: DataFrame, ip_dim: DataFrame, ip: str = "ip") -> DataFrame:
    """Each distinct address once, with its attributes, risk level or error."""
    distinct = ips.select(F.col(ip).alias("ip")).where("ip is not null").dropDuplicates(["ip"])
    asked = distinct.select("ip", is_private(F.col("ip")).alias("is_private"),
                            is_ip(F.col("ip")).alias("_valid"))
    return _verdict(asked.join(ip_dim.withColumn("_hit", F.lit(True)), "ip", "left")
                    .withColumn("_known", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def _blocks(networks: DataFrame) -> DataFrame:
    """The networks cut to prefix blocks: adds ``_prefix`` (the bits that the block's addresses begin
    with, after the family) and ``_width`` (narrower networks sort first)."""
    if "cidr" in networks.columns:
        address, length = F.substring_index("cidr", "/", 1), F.substring_index("cidr", "/", -1).try_cast("int")
        bits = ip_bits(address)
        size = F.length(bits) - 1
        return networks.withColumn("_prefix", F.substring(bits, F.lit(1), length + 1)).withColumn("_width", F.struct(
            (size - length).cast("double").alias("width"), F.lit(0).cast("bigint").alias("lo"))).where(
            length.between(0, size))
    levels = []
    for k in range(33):  # of a range, at most one block on either side for each power of two
        unit = 1 << k
        first, end = F.ceil(F.col("ip_lo") / F.lit(unit)), F.floor((F.col("ip_hi") + 1) / F.lit(unit))
        block = lambda n, k=k: F.concat(F.lit("4"), F.substring(F.lpad(F.bin(n), 32 - k, "0"), 1, 32 - k))
        levels += [F.when((first < end) & (first % 2 == 1 if k < 32 else F.lit(True)), block(first)),
                   F.when((first < end) & (end % 2 == 1), block(end - 1)) if k < 32 else F.lit(None).cast("string")]
    return networks.withColumn("_prefix", F.explode(F.array_compact(F.array(*levels)))).withColumn(
        "_width", F.struct((F.col("ip_hi") - F.col("ip_lo")).cast("double").alias("width"), F.col("ip_lo").cast("bigint").alias("lo")))


def enrich_by_network(ips: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Attributes of the narrowest network that holds the address: ranges of IPv4 (ip_lo, ip_hi as
    numbers), or IPv4 and IPv6 networks (``cidr``, as 10.0.0.0/8 or 2001:db8::/32).

    Networks are cut to prefix blocks, and an address meets them by equality of its prefixes of the
    lengths in use: every pair is a hit. Of equally narrow ranges the lower one counts.
    """
    distinct = ips.select(F.col(ip).alias("ip")).where("ip is not null").dropDuplicates(["ip"])
    blocks = checkpointed(_blocks(networks))
    lengths = sorted(r[0] for r in blocks.select(F.length("_prefix")).distinct().collect())  # at most 163
    prefixes = F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.substring(F.col("_bits"), F.lit(1), n))
    asked = distinct.withColumn("_bits", ip_bits(F.col("ip"))).withColumn(
        "_prefix", F.explode(F.array_distinct(prefixes))).select("ip", "_prefix")
    hits = asked.join(blocks, "_prefix")
    attributes = [c for c in networks.columns if c != "ip"]
    best = hits.groupBy("ip").agg(F.min_by(F.struct(*attributes), F.col("_width")).alias("_net"))
    return distinct.join(best, "ip", "left").select("ip", "_net.*")


def enrich_as_of(events: DataFrame, ip_dim: DataFrame, ip: str, us: str,
                 ttl_seconds: int = ENRICH_TTL_SECONDS) -> DataFrame:
    """Events with the newest dimension row (ip, enriched_us, ...) not younger than the event
    and less than the time to live older.

    Probes and lookups are one table, ordered within (address, slot of one time to live): the last
    lookup before a probe is the last value seen. The last lookup of a slot is copied to the
    beginning of the next one, so no slot needs another, and no lookup meets more than it passes.
    """
    ttl = int(ttl_seconds * 1_000_000)
    slot = lambda c: F.floor(F.col(c) / F.lit(ttl))
    attributes = [c for c in ip_dim.columns if c != "ip"]
    looked = ip_dim.select(F.col("ip").alias("_ip"), slot("enriched_us").alias("_slot"), F.col("enriched_us").alias("_us"),
                           F.lit(1).alias("_kind"), F.struct(*attributes).alias("_row"))
    # of equal times the later row in order of its attributes counts, in every slot alike
    order = F.struct("_us", F.to_json("_row"))
    carried = looked.groupBy("_ip", "_slot").agg(F.max_by("_row", order).alias("_row")).select(
        "_ip", (F.col("_slot") + 1).alias("_slot"), ((F.col("_slot") + 1) * ttl).alias("_us"), F.lit(0).alias("_kind"), "_row")
    probes = events.select(F.col(ip).alias("_ip"), F.col(us).alias("_us")).distinct().select(
        "_ip", slot("_us").alias("_slot"), "_us", F.lit(2).alias("_kind"), F.lit(None).cast(looked.schema["_row"].dataType).alias("_row"))
    before = Window.partitionBy("_ip", "_slot").orderBy("_us", "_kind", F.to_json("_row")).rowsBetween(
        Window.unboundedPreceding, 0)
    seen = looked.unionByName(carried).unionByName(probes).withColumn("_last", F.last("_row", ignorenulls=True).over(before))
    newest = seen.where((F.col("_kind") == 2) & (F.col("_us") - F.col("_last.enriched_us") < ttl)).select("_ip", "_us", "_last")
    joined = events.join(
        newest, (events[ip] == newest["_ip"]) & (events[us] == newest["_us"]), "left")
    return joined.select(*[events[c] for c in events.columns], "_last.*")
