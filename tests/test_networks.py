"""Networks as prefix keys, against the standard library's address arithmetic."""

import ipaddress
import random

from pyspark.sql import functions as F

from pagewise.operators import networks as N


def _network(c):
    try:
        return ipaddress.ip_network(c.strip(), strict=False) if "/" in c else None
    except ValueError:
        return None


def _address(a):
    try:
        x = ipaddress.ip_address(a.strip("[]").split("%")[0])
    except ValueError:
        return None
    return getattr(x, "ipv4_mapped", None) or x


def test_hits_against_address_arithmetic(spark):
    rng = random.Random(8)
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(60)]
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(60)]
    ips += ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "::ffff:10.1.2.3", "64:ff9b::1.2.3.4", "[fe80::1%eth0]", "FD00::AbCd", "10.0.0.1",
            "1.2.3", "256.1.1.1", "1::2::3", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "x", "", ":", ":::", "1:2:3:4:5:6:7::8"]
    cidrs = [f"{i}/{rng.randint(0, 32 if '.' in i else 128)}" for i in ips[:120] for _ in range(3)]
    cidrs += ["0.0.0.0/0", "::/0", "10.0.0.0/8", " fc00::/7 ", "fe80::/10", "1.2.3.4/33", "::/129", "1.2.3.4", "nonsense/8", "::1/128", "64:ff9b::/96"]
    a, n = spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame([(c,) for c in cidrs], "cidr string")
    got = sorted(map(tuple, N.network_hits(a, n).collect()))
    want = set()
    for i in ips:
        x = _address(i)
        for c in cidrs:
            net = _network(c)
            if x is not None and net is not None and x.version == net.version and x in net:
                want.add((i, c))
    assert got == sorted(want) and len(want) > 200
    assert N.network_hits(a, n.limit(0)).count() == 0 and N.network_hits(a.limit(0), n).count() == 0


def test_bits(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("::1",), ("bad",), (None,)], "ip string")
    got = [r.a for r in df.select(N.address_bits(F.col("ip")).alias("a")).collect()]
    assert got[0] == (4, "01020304") and got[1] == (6, "0" * 31 + "1") and got[2] is None and got[3] is None
