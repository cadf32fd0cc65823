"""Report store, network lists and subtotals beyond what the given tables hold."""

import ipaddress
import os
import random

from cadaspark.operators import networks
from cadaspark.sources import sinks

REPORTS = "report_id long, state string, score double, version int"


def files_of(path, state):
    folder = f"{path}/state={state}"
    return {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.startswith("part")} if os.path.isdir(folder) else {}


def test_a_second_write_rewrites_only_touched_states(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [(i, ["Lagos", "Kano", "Ogun", None][i % 4], float(i), 1) for i in range(40)] + [(100, "Alone", 0.0, 1)]
    sinks.upsert_reports(spark.createDataFrame(first, REPORTS), path)
    kano, lagos = files_of(path, "Kano"), files_of(path, "Lagos")
    later = [(0, "Lagos", 99.0, 2), (4, "Lagos", 98.0, 0), (2, "Lagos", 97.0, 2), (100, "Lagos", 96.0, 2), (500, None, 1.0, 1)]
    sinks.upsert_reports(spark.createDataFrame(later, REPORTS), path)
    assert files_of(path, "Kano") == kano and files_of(path, "Lagos") != lagos and files_of(path, "Alone") == {}
    want = {i: (s, v, n) for i, s, v, n in first}
    want |= {0: ("Lagos", 99.0, 2), 2: ("Lagos", 97.0, 2), 100: ("Lagos", 96.0, 2), 500: (None, 1.0, 1)}
    got = [(r.report_id, (r.state, r.score, r.version)) for r in sinks.stored_reports(spark, path).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_a_hundred_thousand_networks(spark):
    rng = random.Random(2)
    nets = {str(ipaddress.ip_network((rng.randrange(1 << 32), rng.randint(9, 32)), strict=False)) for _ in range(100_000)}
    hosts = [(i, str(ipaddress.ip_address(rng.randrange(1 << 32)))) for i in range(400)]
    hosts += [(1000, "a.b.Example.org."), (1001, "example.org"), (1002, "badexample.org"), (1003, ""), (1004, None), (1005, "300.1.1.1"), (1006, "x.b.example.org")]
    names = spark.createDataFrame([("example.org",), (" b.example.org ",), ("",), (None,)], "name string")
    lists = spark.createDataFrame([(n,) for n in nets] + [("10.0.0.0/99",), ("nonsense",), (None,)], "network string")
    got = {r.id: r.listed_by for r in networks.listed(spark.createDataFrame(hosts, "id long, host string"), lists, names).collect()}
    by_key = {(n.prefixlen, int(n.network_address)): str(n) for n in map(ipaddress.ip_network, nets)}
    for i, host in hosts[:400]:
        number = int(ipaddress.ip_address(host))
        found = [by_key.get((k, number >> (32 - k) << (32 - k))) for k in range(32, 8, -1)]
        assert got[i] == next((f for f in found if f), None)
    assert [got[i] for i in range(1000, 1007)] == ["b.example.org", "example.org", None, None, None, None, "b.example.org"]
    empty = networks.listed(spark.createDataFrame(hosts, "id long, host string"), lists.limit(0), names.limit(0))
    assert empty.where("listed_by IS NOT NULL").count() == 0 and empty.count() == len(hosts)
