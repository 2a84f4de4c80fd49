"""Binary extracts: a small writer of the format, and the reader against it."""

import struct
import zlib

import numpy as np
import pytest

from stradale.sources import pbf, registry


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zigzag(n):
    return varint(n << 1 ^ n >> 63)


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def deltas(x):
    return b"".join(zigzag(int(v)) for v in np.diff([0, *x]))


def blob(kind, data, packed=True):
    body = field(3, zlib.compress(data)) + field(2, len(data)) if packed else field(1, data)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def extract(nodes, ways, dense=True):
    """One block of nodes and one of ways."""
    units = lambda v: round(v * 1e7)
    if dense:
        group = field(2, field(1, deltas([n for n, _, _ in nodes])) + field(8, deltas([units(y) for _, _, y in nodes])) + field(9, deltas([units(x) for _, x, _ in nodes])))
    else:
        group = b"".join(field(1, varint(1 << 3) + zigzag(n) + varint(8 << 3) + zigzag(units(y)) + varint(9 << 3) + zigzag(units(x))) for n, x, y in nodes)
    table = sorted({s for _, tags, _ in ways for kv in tags.items() for s in kv})
    at = {s: i + 1 for i, s in enumerate(table)}
    lines = b"".join(
        field(3, field(1, w) + field(2, b"".join(varint(at[k]) for k in tags)) + field(3, b"".join(varint(at[v]) for v in tags.values())) + field(8, deltas(refs))) for w, tags, refs in ways
    )
    strings = field(1, b"".join(field(1, s.encode()) for s in ["", *table]))
    return blob(b"OSMHeader", b"") + blob(b"OSMData", field(2, group), dense) + blob(b"OSMData", strings + field(2, lines))


NODES = [(5, -115.25, 36.125), (9, -115.2, 36.2), (2, -115.1, -36.3), (70000000000, 0.0, 0.0)]
WAYS = [(11, {"highway": "primary", "name": "Straße", "lanes": "2"}, [5, 9, 70000000000]), (12, {"highway": "footway"}, [9, 404, 2]), (13, {"building": "yes"}, [5, 9]), (14, {"highway": "service"}, [404, 5])]


@pytest.mark.parametrize("dense", [True, False])
def test_extracts(spark, tmp_path, dense):
    (tmp_path / "a.osm.pbf").write_bytes(extract(NODES, WAYS, dense))
    got = {r["osm_id"]: r for r in registry.load(registry.WAYS, "pbf", spark, str(tmp_path)).collect()}
    assert set(got) == {"11", "12"}  # way 14 has one known node only
    at = lambda r: [v for p in r["pts"] for v in (p["x"], p["y"])]
    assert at(got["11"]) == pytest.approx([-115.25, 36.125, -115.2, 36.2, 0.0, 0.0]) and at(got["12"]) == pytest.approx([-115.2, 36.2, -115.1, -36.3])
    assert got["11"]["other_tags"] == '"name"=>"Straße","lanes"=>"2"' and got["12"]["highway"] == "footway"
    assert (got["12"]["minx"], got["12"]["maxy"]) == pytest.approx((-115.2, 36.2))


def test_packed_numbers():
    x = [0, 1, 127, 128, 300, 2**32, 2**63 - 1, 2**64 - 1]
    assert pbf.packed(b"".join(varint(v) for v in x)).tolist() == x and pbf.packed(b"").tolist() == []
    y = [0, -1, 1, -(2**40), 2**62, -(2**63)]
    assert pbf.signed(pbf.packed(b"".join(zigzag(v) for v in y))).tolist() == y
    with pytest.raises(ValueError):
        list(pbf.message(bytes([3])))
