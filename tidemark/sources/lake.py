"""The storage-metadata tables as views over a table directory.

Every view is defined once, in SQL that Spark and DuckDB both read; ``{div}`` stands for
integer division and ``{epoch(x)}`` for seconds since 1970.  ``Lake`` gives the views as
DataFrames, ``with_clause`` gives the same definitions as common table expressions.

Identifiers do not collide between levels of the namespace: root 0, regions from 1,
nations from 100, customers from 1,000,000, orders (files) from 10,000,000,000.
Views carry a few deliberate faults (by remainders of ids), so audits have findings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
EXTENT_BYTES = 32768

_SEGMENT = "PARTITION BY year(l_shipdate), dayofyear(l_shipdate), l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"

VIEWS: dict[str, str] = {
    # append log of frames, one per written extent
    "frame": f"""SELECT 10000000000 + l_orderkey AS inode, CAST(l_linenumber - 1 AS BIGINT) AS extent, CAST(year(l_shipdate) AS BIGINT) AS epoch,
  CAST(dayofyear(l_shipdate) * 10 + l_suppkey % 10 AS BIGINT) AS counter, CAST(row_number() OVER ({_SEGMENT}) - 1 AS BIGINT) AS frame_index,
  CAST(coalesce(sum(CAST(round(l_extendedprice) AS BIGINT)) OVER ({_SEGMENT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
  CAST(round(l_extendedprice) AS BIGINT) AS byte_len FROM lineitem""",
    "frame_state": """SELECT *, row_number() OVER (PARTITION BY inode, extent ORDER BY epoch DESC, counter DESC, frame_index DESC) = 1 AS live FROM frame""",
    "extent": "SELECT inode, extent, epoch, counter, frame_index, byte_offset, byte_len FROM frame_state WHERE live",
    "segcount": """SELECT epoch, counter, CAST(sum(byte_len) AS BIGINT) AS total, CAST(sum(CASE WHEN live THEN byte_len ELSE 0 END) AS BIGINT) AS live
  FROM frame_state GROUP BY epoch, counter""",
    "file_extent": "SELECT inode, max(extent) AS last_extent, CAST(count(*) AS BIGINT) AS extents, CAST(sum(byte_len) AS BIGINT) AS bytes FROM extent GROUP BY inode",
    # names in directories: every object once, some files twice; one nation is in no directory, so what is below it is detached
    "dir_name": """SELECT 0 AS dir_id, r_name AS name, CAST(1 + r_regionkey AS BIGINT) AS inode_id FROM region
  UNION ALL SELECT CAST(1 + n_regionkey AS BIGINT), n_name, CAST(100 + n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT CAST(100 + c_nationkey AS BIGINT), c_name, 1000000 + c_custkey FROM customer
  UNION ALL SELECT 1000000 + o_custkey, concat('order-', CAST(o_orderkey AS STRING)), 10000000000 + o_orderkey FROM orders WHERE o_orderkey % 107 <> 5
  UNION ALL SELECT 0, concat('link-', CAST(o_orderkey AS STRING)), 10000000000 + o_orderkey FROM orders WHERE o_orderkey % 53 = 1""",
    "dir_entry": """SELECT CAST(dir_id AS BIGINT) AS dir_id, name, inode_id, CAST(row_number() OVER (PARTITION BY dir_id ORDER BY inode_id, name) + 2 AS BIGINT) AS cookie FROM dir_name WHERE inode_id <> 124""",
    "inode": f"""SELECT CAST(0 AS BIGINT) AS inode_id, 'directory' AS kind, CAST(0 AS BIGINT) AS size, CAST(493 AS BIGINT) AS mode, CAST(0 AS BIGINT) AS uid, CAST(0 AS BIGINT) AS gid,
    CAST(2 + (SELECT count(*) FROM region) AS BIGINT) AS nlink, CAST(0 AS BIGINT) AS parent, CAST(NULL AS STRING) AS name,
    CAST((SELECT count(*) FROM dir_name WHERE dir_id = 0) AS BIGINT) AS entry_count, CAST(0 AS BIGINT) AS mtime
  UNION ALL SELECT inode_id, 'directory', 0, CASE WHEN inode_id % 4 = 1 THEN 1023 ELSE 493 END, inode_id % 7, inode_id % 5, 2 + subdirs + CASE WHEN inode_id % 103 = 2 THEN 1 ELSE 0 END, parent, name,
    children + CASE WHEN inode_id % 101 = 0 THEN 1 ELSE 0 END, inode_id % 100000
  FROM (SELECT d.inode_id, max(d.dir_id) AS parent, max(d.name) AS name, count(c.inode_id) AS children, count(CASE WHEN c.inode_id < 10000000000 THEN 1 END) AS subdirs
    FROM dir_name d LEFT JOIN dir_name c ON c.dir_id = d.inode_id WHERE d.inode_id < 10000000000 GROUP BY d.inode_id) dirs
  UNION ALL SELECT 10000000000 + o_orderkey, CASE o_orderkey % 97 WHEN 5 THEN 'symlink' WHEN 6 THEN 'fifo' WHEN 7 THEN 'socket' WHEN 8 THEN 'char_device' WHEN 9 THEN 'block_device' ELSE 'file' END,
    CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey % 50 + 1 WHEN o_orderkey % 97 BETWEEN 6 AND 9 THEN 0
      ELSE greatest(0, (coalesce(last_extent, -1) + 1 - CASE WHEN o_orderkey % 71 = 3 THEN 2 ELSE 0 END) * {EXTENT_BYTES} - CASE WHEN last_extent IS NULL THEN 0 ELSE o_orderkey % 1000 END) END,
    CASE o_orderkey % 6 WHEN 0 THEN 416 WHEN 1 THEN 420 WHEN 2 THEN 384 WHEN 3 THEN 509 WHEN 4 THEN 2541 ELSE 0 END, o_custkey % 7, o_custkey % 5,
    CASE WHEN o_orderkey % 53 = 1 THEN 2 WHEN o_orderkey % 59 = 4 THEN 3 ELSE 1 END,
    CASE WHEN o_orderkey % 53 = 1 THEN NULL ELSE 1000000 + o_custkey END, CASE WHEN o_orderkey % 53 = 1 THEN NULL ELSE concat('order-', CAST(o_orderkey AS STRING)) END, NULL, {{epoch(o_orderdate)}}
  FROM orders LEFT JOIN file_extent ON inode = 10000000000 + o_orderkey WHERE o_orderkey % 97 <> 96""",
    # listing index: embeds the attributes of objects with one link
    "dir_scan": """SELECT e.dir_id, e.cookie, CASE WHEN e.inode_id % 83 = 2 THEN concat(e.name, '~') ELSE e.name END AS name, e.inode_id,
    CASE WHEN i.nlink = 1 THEN i.size + CASE WHEN e.inode_id % 79 = 1 THEN 1 ELSE 0 END END AS e_size, CASE WHEN i.nlink = 1 THEN i.mode END AS e_mode, CASE WHEN i.nlink = 1 THEN i.uid END AS e_uid
  FROM dir_entry e LEFT JOIN inode i ON i.inode_id = e.inode_id WHERE e.inode_id % 89 <> 3
  UNION ALL SELECT dir_id, cookie + 1000000, concat(name, '#'), inode_id, NULL, NULL, NULL FROM dir_entry WHERE inode_id % 113 = 7""",
    "dir_cookie": """SELECT dir_id, CAST(max(cookie) + CASE WHEN dir_id % 109 = 11 THEN 0 ELSE 1 END AS BIGINT) AS next_cookie FROM dir_entry GROUP BY dir_id
  UNION ALL SELECT 10000000000 + o_orderkey, CAST(3 AS BIGINT) FROM orders WHERE o_orderkey % 997 = 1""",
    "stats_shard": """SELECT inode_id % 100 AS shard_id, CAST(sum(CASE WHEN kind = 'file' THEN size ELSE 0 END) + CASE WHEN inode_id % 100 = 42 THEN 5 ELSE 0 END AS BIGINT) AS used_bytes, CAST(count(*) AS BIGINT) AS used_inodes
  FROM inode WHERE inode_id <> 0 GROUP BY inode_id % 100""",
    "tombstone": """SELECT {epoch(o_orderdate)} AS ts, 10000000000 + o_orderkey AS inode_id, CAST(o_orderkey % 300000 * 7 AS BIGINT) AS remaining_size FROM orders WHERE o_orderkey % 97 = 96 AND o_orderkey % 2 = 0 OR o_orderkey % 311 = 5""",
    "orphan": "SELECT 10000000000 + o_orderkey AS inode_id FROM orders WHERE o_orderkey % 107 = 5 AND o_orderkey % 3 = 0 OR o_orderkey % 503 = 2",
    # objects that the store lists: some segments are missing, some objects have no counter
    "segment_object": """SELECT epoch, counter, epoch * 400 + counter {div} 10 AS mtime, total AS size FROM segcount WHERE counter % 41 <> 3
  UNION ALL SELECT epoch, counter + 100000, epoch * 400 + counter {div} 10, total FROM segcount WHERE counter % 97 = 1""",
    "checkpoint": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('nightly-', CAST(o_orderkey AS STRING)) END AS name, {epoch(o_orderdate)} AS created_at,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {epoch(o_orderdate)} + o_orderkey % 86400 END AS expires_at FROM orders WHERE o_orderkey % 50 = 1 OR o_orderkey % 50 = 0""",
    # reads and writes of files by users
    "access": """SELECT event_id, {epoch(ts)} AS ts, user_id, CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'lookup' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'create' ELSE 'remove' END AS operation,
    10000000000 + event_id % (SELECT max(o_orderkey) + 1 FROM orders) AS inode, event_id * 37 % 200000 AS offset, CAST(floor(abs(value)) AS BIGINT) * 100 + 1 AS length FROM events""",
    "object_access": """SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'wal' ELSE 'meta' END AS store, CASE operation WHEN 'read' THEN 'get' WHEN 'write' THEN 'put' WHEN 'remove' THEN 'delete' ELSE 'head' END AS op,
    concat('segments/', CAST(event_id % 17 AS STRING)) AS path, length * 3 AS duration_us, event_id % 29 = 0 AS error FROM access""",
    "snapshot": """SELECT minute * 60 AS ts, CAST(sum(reads) OVER (ORDER BY minute) AS BIGINT) AS read_ops, CAST(sum(writes) OVER (ORDER BY minute) AS BIGINT) AS write_ops, CAST(sum(bytes) OVER (ORDER BY minute) AS BIGINT) AS read_bytes, CAST(errors AS BIGINT) AS gauge
  FROM (SELECT ts {div} 60 AS minute, count(CASE WHEN operation = 'read' THEN 1 END) AS reads, count(CASE WHEN operation = 'write' THEN 1 END) AS writes, sum(CASE WHEN operation = 'read' THEN length ELSE 0 END) AS bytes, count(CASE WHEN operation = 'remove' THEN 1 END) AS errors
    FROM access GROUP BY ts {div} 60) per_minute""",
    # ordered changes: batch = seqno, a few ops each
    "change": """SELECT CAST(l_orderkey % 3 AS BIGINT) AS epoch, l_orderkey AS seqno, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS op_index, CASE WHEN l_suppkey % 5 = 0 THEN 'delete' ELSE 'put' END AS op,
    l_partkey % 997 AS key, CAST(round(l_extendedprice) AS BIGINT) AS value FROM lineitem""",
    "lock": """SELECT DISTINCT l_partkey % 50 AS inode, l_suppkey % 7 AS owner, CASE WHEN l_linestatus = 'O' THEN 'write' ELSE 'read' END AS kind, l_orderkey * 13 % 4000 AS start, CASE WHEN l_orderkey % 41 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS length
  FROM lineitem WHERE l_orderkey % 11 = 0""",
    # pairs of segments that one read crossed
    "seam_event": """SELECT event_id, ts, ts {div} 3600 AS round, CAST(1995 + user_id % 2 AS BIGINT) AS epoch_a, 10 + CASE WHEN event_id % 2 = 0 THEN user_id % 40 ELSE user_id * 7 % 40 END AS counter_a,
    CAST(1995 + (user_id + event_id) % 2 AS BIGINT) AS epoch_b, 10 + (user_id * 3 + event_id % 3) % 40 AS counter_b FROM access""",
    "bench_run": """SELECT operation AS benchmark, event_id, length AS duration, event_id % 29 <> 0 AS success, CASE WHEN event_id % 29 = 0 THEN concat('E', CAST(user_id % 4 AS STRING)) END AS error FROM access""",
    "op_log": """SELECT event_id % 2000 AS op_id, event_id, ts FROM access""",
    "history": """SELECT event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'info' WHEN 1 THEN 'fail' ELSE 'ok' END AS type, CASE WHEN event_id % 5 = 0 THEN 'remove' ELSE 'add' END AS f, event_id % 700 AS value FROM access""",
    "final_read": "SELECT DISTINCT event_id % 700 AS value FROM access WHERE event_id % 3 <> 0 AND event_id % 700 < 600",
}


def _render(sql: str, spark: bool) -> str:
    sql = sql.replace("{div}", "div" if spark else "//")
    sql = re.sub(r"\{epoch\((\w+)\)\}", r"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1) AS BIGINT)" if spark else r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
    return sql


def _used(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def _closure(sql: str) -> list[str]:
    """Views that a statement needs, each after those it is made of."""
    need: set[str] = set()
    todo = _used(re.sub(r"\w+\.", "", sql), VIEWS)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += [n for n in _used(VIEWS[name], VIEWS) if n != name]
    return [n for n in VIEWS if n in need]


_ORDER = {name: k for k, name in enumerate(VIEWS)}


def with_clause(sql: str) -> str:
    """The statement with the definitions of its views in front, for DuckDB."""
    names = _closure(sql)
    # a view only uses views that stand before it, but for dir_entry and inode, whose order is theirs
    defs = ",\n".join(f"{n} AS MATERIALIZED ({_render(VIEWS[n], spark=False)})" for n in names)
    body = sql.strip()
    if not defs:
        return body
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {defs},\n{body[14:].lstrip()}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {defs},\n{body[4:].lstrip()}"
    return f"WITH {defs}\n{body}"


class Lake:
    """Views by attribute, as lazy DataFrames over the Parquet tables of a directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                sql = VIEWS[name]
                parts = {n: getattr(self, n) for n in _used(sql, (*BASE, *VIEWS)) if n != name and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}
                text = _render(sql, spark=True)
                for n in parts:
                    text = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", text)
                self._made[name] = self.spark.sql(text, **parts)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]
