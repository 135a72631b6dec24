"""Hosts, flows and devices as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.draws import keyed_hash
from packetlake.functions.net import address_scope, ipv4_from_text, node_label
from packetlake.operators.flows import seen_ips
from packetlake.operators.skew import SALTS, join_salted

NODE_KEY = ["label", "address", "type"]
EDGE_KEY = ["label", "src", "dst", "protocol", "src_port", "dst_port"]
EDGE_STATS = [
    "fwd_packet_count",
    "bwd_packet_count",
    "fwd_byte_count",
    "bwd_byte_count",
    "first_seen",
    "last_seen",
    "duration_ms",
    "min_packet_size",
    "max_packet_size",
    "avg_packet_size",
    "avg_pps",
    "avg_bps",
]


def as_nodes(addresses: DataFrame) -> DataFrame:
    """Address nodes with their version label and internal/external type."""
    address = F.col("address")
    return addresses.select(node_label(address).alias("label"), "address", address_scope(address).alias("type"))


def ip_nodes(packets: DataFrame) -> DataFrame:
    return as_nodes(seen_ips(packets))


def merge_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the nodes that are not there yet; a node is its label, address and type."""
    return existing.select(*NODE_KEY).unionByName(new.select(*NODE_KEY)).distinct()


def flow_edges(flows: DataFrame) -> DataFrame:
    """Edges as the graph holds them: whole seconds, duration in milliseconds."""
    return flows.select(
        node_label(F.col("ip_lo")).alias("label"),
        F.col("ip_lo").alias("src"),
        F.col("ip_hi").alias("dst"),
        "protocol",
        F.col("port_lo").alias("src_port"),
        F.col("port_hi").alias("dst_port"),
        "fwd_packet_count",
        "bwd_packet_count",
        "fwd_byte_count",
        "bwd_byte_count",
        F.expr("first_seen_us div 1000000").alias("first_seen"),
        F.expr("last_seen_us div 1000000").alias("last_seen"),
        F.expr("duration_us div 1000").alias("duration_ms"),
        "min_packet_size",
        "max_packet_size",
        "avg_packet_size",
        "avg_pps",
        "avg_bps",
    )


def edges_between(edges: DataFrame, nodes: DataFrame, salts: int = SALTS) -> DataFrame:
    """The edges both of whose endpoints are nodes.

    A busy server is the endpoint of a large share of all flows, so the keys are
    salted.
    """
    known = nodes.select("label", "address").distinct()
    kept = edges
    for end in ("src", "dst"):
        kept = join_salted(kept, known.withColumnRenamed("address", end), ["label", end], "left_semi", salts)
    return kept


def _all_equal(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def merge_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the edges that do not exist with all properties equal."""
    columns = [*EDGE_KEY, *EDGE_STATS]
    fresh = new.select(*columns).distinct()
    missing = fresh.join(existing, _all_equal(fresh, existing, columns), "left_anti")
    return existing.select(*columns).unionByName(missing)


def update_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Sets the statistics of existing edges with the same endpoints, protocol and ports.

    Parallel edges are all set. Edges without a match keep their values, and
    new flows are not added. ``new`` has one row per edge key.
    """
    renamed = new.select(*EDGE_KEY, F.struct(*EDGE_STATS).alias("__new"))
    joined = existing.join(renamed, EDGE_KEY, "left")
    # Taken whole, so a NULL statistic of the new edge also replaces the old one.
    stats = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in EDGE_STATS]
    return joined.select(*EDGE_KEY, *stats)


def upsert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``update_edges``, then the flows that had no edge."""
    added = new.join(existing.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti")
    return update_edges(existing, new).unionByName(added.select(*EDGE_KEY, *EDGE_STATS))


def push_edges(existing: DataFrame, new: DataFrame, mode: str = "append") -> DataFrame:
    """``append`` makes parallel edges on every push; ``upsert`` keeps one per key."""
    if mode == "append":
        return existing.select(*EDGE_KEY, *EDGE_STATS).unionByName(new.select(*EDGE_KEY, *EDGE_STATS))
    if mode == "upsert":
        return upsert_edges(existing, new)
    raise ValueError(f"mode must be append or upsert, not {mode!r}")


# --- devices ---------------------------------------------------------------


def device_nodes(devices: DataFrame) -> DataFrame:
    """One node per name and roles; devices without addresses are left out."""
    return devices.filter(F.size("ip_addresses") > 0).select("name", "roles").distinct()


def device_addresses(devices: DataFrame) -> DataFrame:
    """Name, address text and the IPv4 address, NULL where the text is not one."""
    listed = devices.filter(F.size("ip_addresses") > 0).select("name", F.explode("ip_addresses").alias("address_text"))
    return listed.withColumn("address", ipv4_from_text(F.col("address_text"))).distinct()


def device_controls(devices: DataFrame) -> DataFrame:
    """CONTROLS edges from device name to address, with the address type."""
    valid = device_addresses(devices).filter(F.col("address").isNotNull())
    return valid.select("name", "address", address_scope(F.col("address")).alias("type"))


def invalid_device_addresses(devices: DataFrame) -> DataFrame:
    return device_addresses(devices).filter(F.col("address").isNull()).select("name", "address_text")


def flows_by_device(flows: DataFrame, controls: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every flow with the devices that control either end, one row per pairing."""
    named = controls.select("address", "name").distinct()
    result = flows
    for end, name in (("ip_lo", "device_lo"), ("ip_hi", "device_hi")):
        side = named.select(F.col("address").alias(end), F.col("name").alias(name))
        result = join_salted(result, side, [end], "left", salts)
    return result


def device_sets(controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses with the number of their set of devices, and the sets.

    The first table has ``address, set_id``, one row per address; the second
    ``set_id, name``. Addresses with the same devices share a set, which is known
    by the smallest of them, so its names are stored once. Sets are compared by
    their size and two sums of independent 60-bit numbers of the names: no set
    is gathered, however many devices an address has.
    """
    named = controls.select("address", "name").filter("address IS NOT NULL AND name IS NOT NULL").distinct()
    sums = [F.sum(keyed_hash(seed, F.col("name")).cast("decimal(20,0)")).alias(f"__s{seed}") for seed in (0, 1)]
    marks = named.groupBy("address").agg(F.count(F.lit(1)).alias("__n"), *sums)
    same = marks.groupBy("__n", "__s0", "__s1").agg(F.min("address").alias("set_id"))
    numbered = marks.join(same, ["__n", "__s0", "__s1"]).select("address", "set_id")
    return numbered, named.join(same.select(F.col("set_id").alias("address")), "address").withColumnRenamed("address", "set_id")


def with_device_sets(flows: DataFrame, addresses: DataFrame) -> DataFrame:
    """Every flow once, with the sets of devices that control its ends, NULL for none.

    A flow between addresses of ``m`` and ``n`` devices stays one row, not ``m * n``.
    """
    result = flows
    for end, name in (("ip_lo", "devices_lo"), ("ip_hi", "devices_hi")):
        result = result.join(addresses.select(F.col("address").alias(end), F.col("set_id").alias(name)), end, "left")
    return result.select(*flows.columns, "devices_lo", "devices_hi")


def expand_device_sets(flows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``flows_by_device`` from ``with_device_sets``; filter first, as this makes every pairing."""
    result = flows
    for given, name in (("devices_lo", "device_lo"), ("devices_hi", "device_hi")):
        result = result.join(sets.select(F.col("set_id").alias(given), F.col("name").alias(name)), given, "left")
    return result.drop("devices_lo", "devices_hi")


def device_traffic(flows: DataFrame, sets: DataFrame) -> DataFrame:
    """Flows, packets and bytes per device and end of the flow, from ``with_device_sets``.

    Flows are summed per set before names are joined, so the work does not grow
    with the number of devices of a busy address.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"devices_{e}").alias("set_id")) for e in ("lo", "hi")]))
    numbers = {
        "packets": F.col("fwd_packet_count") + F.col("bwd_packet_count"),
        "bytes": F.col("fwd_byte_count") + F.col("bwd_byte_count"),
    }
    per_end = flows.select(ends.alias("__e"), *[c.alias(n) for n, c in numbers.items()]).filter("__e.set_id IS NOT NULL")
    per_set = per_end.groupBy("__e.end", "__e.set_id").agg(F.count(F.lit(1)).alias("flows"), *[F.sum(n).alias(n) for n in numbers])
    return per_set.join(sets, "set_id").groupBy("name", "end").agg(*[F.sum(n).alias(n) for n in ("flows", *numbers)])


# --- small graph queries ---------------------------------------------------


def person_nodes(numbers: DataFrame) -> DataFrame:
    """Demo nodes from whole numbers in ``id``."""
    return numbers.select(
        "id",
        F.concat(F.lit("Person_"), F.col("id").cast("string")).alias("name"),
        (F.col("id") + 20).alias("age"),
        (F.col("id") % 2 == 0).alias("active"),
    )


def next_edges(nodes: DataFrame) -> DataFrame:
    """An edge from every node to the one with the following id, if there is one."""
    return nodes.select(F.col("id").alias("src")).join(
        nodes.select(F.col("id").alias("dst"), (F.col("id") - 1).alias("src")), "src"
    )


def neighbours(nodes: DataFrame, edges: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The first nodes by key, each with its outgoing edges' other ends if it has any."""
    right = nodes.select(F.col(key).alias("dst"), F.col("name").alias("neighbour"))
    outgoing = edges.select("src", "dst").join(right, "dst", "left")
    return (
        nodes.join(outgoing.withColumnRenamed("src", key), key, "left")
        .select(key, "name", "dst", "neighbour")
        .orderBy(key, "dst")
        .limit(limit)
    )


