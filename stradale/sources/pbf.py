"""Ways of OpenStreetMap extracts in their binary format (public wire format: blobs of protocol buffers).

A file is a row of blobs, each a block of nodes or of ways. Blobs are dealt out as rows, parsed in Arrow
maps, and the ways' node references are joined with the nodes by their numbers, so that neither side
needs a table of all nodes in one process. Spark's binary files hold at most 2 GB each; larger extracts
are to be cut by their authors' tools first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import WAYS, register

# --- fixed values: field numbers of the format ---------------------------------------------------------
BLOB_TYPE, BLOB_SIZE = 1, 3
RAW, ZLIB = 1, 3
STRINGS, GROUPS, GRANULARITY, LAT_OFFSET, LON_OFFSET = 1, 2, 17, 19, 20
NODE, DENSE, WAY = 1, 2, 3
IDS, KEYS, VALUES, REFS, LATS, LONS = 1, 2, 3, 8, 8, 9
# ----------------------------------------------------------------------------------------------------------


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def message(data: bytes):
    """(field number, value) of a message: whole numbers, or bytes of nested fields."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def packed(data: bytes) -> np.ndarray:
    """A packed field of whole numbers, all at once."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag numbers."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def blobs(content: bytes) -> list[bytes]:
    """The data blobs of a file, still compressed; header blobs are left out."""
    out, at = [], 0
    while at < len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        head = dict(message(content[at + 4 : at + 4 + n]))
        at += 4 + n
        size = head[BLOB_SIZE]
        if head[BLOB_TYPE] == b"OSMData":
            out.append(content[at : at + size])
        at += size
    return out


def block(blob: bytes) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(nodes: id, x, y; ways: osm_id, highway, other_tags, refs) of a blob; ways without a highway tag are left out."""
    parts = dict(message(blob))
    data = parts[RAW] if RAW in parts else zlib.decompress(parts[ZLIB])
    strings: list[str] = []
    groups, scale, lat0, lon0 = [], 100, 0, 0
    for k, v in message(data):
        if k == STRINGS:
            strings = [s.decode("utf-8", "replace") for f, s in message(v) if f == 1]
        elif k == GROUPS:
            groups.append(v)
        elif k == GRANULARITY:
            scale = v
        elif k == LAT_OFFSET:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif k == LON_OFFSET:
            lon0 = v - (1 << 64) if v >> 63 else v
    ids, lats, lons, ways = [], [], [], []
    for g in groups:
        for k, v in message(g):
            if k == DENSE:
                f = dict(message(v))
                for into, field in ((ids, IDS), (lats, LATS), (lons, LONS)):
                    into.append(np.cumsum(signed(packed(f.get(field, b"")))))
            elif k == NODE:
                f = dict(message(v))
                for into, field in ((ids, IDS), (lats, LATS), (lons, LONS)):
                    into.append(signed(np.array([f.get(field, 0)], np.uint64)))
            elif k == WAY:
                f = dict(message(v))
                tags = {strings[a]: strings[b] for a, b in zip(packed(f.get(KEYS, b"")), packed(f.get(VALUES, b"")))}
                if "highway" in tags:
                    rest = ",".join(f'"{a}"=>"{b}"' for a, b in tags.items() if a != "highway")
                    ways.append((str(f[IDS]), tags["highway"], rest, np.cumsum(signed(packed(f.get(REFS, b""))))))
    join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    degrees = lambda x, zero: (join(x) * scale + zero) * 1e-9
    nodes = pd.DataFrame({"id": join(ids), "x": degrees(lons, lon0), "y": degrees(lats, lat0)})
    return nodes, pd.DataFrame(ways, columns=["osm_id", "highway", "other_tags", "refs"])


@register(WAYS, "pbf")
def way_pbf(spark: SparkSession, path: str) -> DataFrame:
    """Ways of extracts: osm_id, highway, other_tags, pts in degrees, and their boxes.

    References to nodes that a file does not have are left out, as at an extract's edge.
    """
    from ..store import stored
    from .ways import with_boxes

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cut(batches):
        for rows in batches:
            for p, c in zip(rows.path, rows.content):
                found = blobs(bytes(c))
                for lo in range(0, len(found), 64):
                    yield pd.DataFrame({"path": p, "blob": found[lo : lo + 64]})

    # as many tasks as the session has partitions: blobs are small to carry and slow to parse
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(spark, files.mapInPandas(cut, "path string, blob binary").repartition(n), "blobs")

    def nodes(batches):
        for rows in batches:
            for p, b in zip(rows.path, rows.blob):
                yield block(bytes(b))[0].assign(path=p)[["path", "id", "x", "y"]]

    def ways(batches):
        for rows in batches:
            for p, b in zip(rows.path, rows.blob):
                yield block(bytes(b))[1].assign(path=p)[["path", "osm_id", "highway", "other_tags", "refs"]]

    at = parts.mapInPandas(nodes, "path string, id long, x double, y double")
    w = stored(spark, parts.mapInPandas(ways, "path string, osm_id string, highway string, other_tags string, refs array<long>"), "pbf-ways")
    refs = w.select("path", "osm_id", F.posexplode("refs").alias("k", "id"))
    pts = refs.join(at, ["path", "id"]).groupBy("path", "osm_id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))  # the points of one way
    pts = pts.select("path", "osm_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("pts"))
    return with_boxes(w.join(pts, ["path", "osm_id"]).select("osm_id", "highway", "other_tags", "pts"))
