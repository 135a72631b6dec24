"""Flows with numbered sets of devices instead of all pairs of devices."""

import collections

from packetlake.operators.graph import device_sets, device_traffic, expand_device_sets, flows_by_device, with_device_sets

FLOWS = "ip_lo binary, ip_hi binary, port_lo int, fwd_packet_count long, bwd_packet_count long, fwd_byte_count long, bwd_byte_count long"


def address(n):
    return bytes([10, 0, 0, n])


def test_flows_stay_single_rows_and_expand_to_all_pairs(spark):
    many = [f"d{i}" for i in range(50)]
    owned = {1: many, 2: many, 3: many[:49], 4: ["d0"], 5: ["d0"], 6: ["x"]}
    rows = [(name, address(a)) for a, names in owned.items() for name in names]
    controls = spark.createDataFrame([*rows, *rows[:7], ("y", None), (None, address(6))], "name string, address binary")
    ends = [(1, 2), (1, 3), (2, 1), (4, 5), (6, 7), (7, 8), (1, 1)]
    flows = spark.createDataFrame([(address(a), address(b), i, i, 1, 10 * i, 5) for i, (a, b) in enumerate(ends)], FLOWS)
    addresses, sets = device_sets(controls)
    numbers = {r.address[3]: r.set_id[3] for r in addresses.collect()}
    assert numbers == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert sets.count() == 50 + 49 + 1 + 1
    short = with_device_sets(flows, addresses)
    assert short.count() == len(ends)

    def pairs(table):
        return collections.Counter((r.port_lo, r.device_lo, r.device_hi) for r in table.collect())

    known = controls.filter("name IS NOT NULL")
    assert pairs(expand_device_sets(short, sets)) == pairs(flows_by_device(flows, known))
    expected = collections.defaultdict(lambda: [0, 0, 0])
    for i, (a, b) in enumerate(ends):
        for end, at in (("lo", a), ("hi", b)):
            for name in owned.get(at, []):
                expected[name, end] = [x + y for x, y in zip(expected[name, end], (1, i + 1, 10 * i + 5))]
    got = {(r.name, r.end): [r.flows, r.packets, r.bytes] for r in device_traffic(short, sets).collect()}
    assert got == dict(expected)


def test_no_devices_and_no_flows(spark):
    controls = spark.createDataFrame([], "name string, address binary")
    flows = spark.createDataFrame([(address(1), None, 1, 1, 1, 1, 1)], FLOWS)
    addresses, sets = device_sets(controls)
    short = with_device_sets(flows, addresses)
    assert [(r.devices_lo, r.devices_hi) for r in short.collect()] == [(None, None)]
    assert expand_device_sets(short, sets).count() == 1 and device_traffic(short, sets).count() == 0
    assert with_device_sets(flows.limit(0), addresses).count() == 0
