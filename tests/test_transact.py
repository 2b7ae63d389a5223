"""Batches of operations leave tables that every audit passes, and do what one operation after the other does."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, liveness, transact

SCHEMAS = {
    "inode": "inode_id long, kind string, size long, mode long, uid long, gid long, nlink long, parent long, name string, entry_count long, mtime long", "dir_entry": "dir_id long, name string, inode_id long, cookie long",
    "dir_scan": "dir_id long, cookie long, name string, inode_id long, e_size long, e_mode long, e_uid long", "dir_cookie": "dir_id long, next_cookie long", "stats_shard": "shard_id long, used_bytes long, used_inodes long",
    "tombstone": "ts long, inode_id long, remaining_size long", "orphan": "inode_id long",
}


class Model:
    """A namespace as dictionaries, one operation at a time."""

    def __init__(self):
        self.inode = {0: dict(kind="directory", size=0, mode=493, uid=0, gid=0, parent=0, name=None)}
        self.entry, self.orphans, self.stones = {}, set(), {}

    def below(self, d, top):
        while True:
            if d == top:
                return True
            if d == 0:
                return False
            d = self.inode[d]["parent"]

    def names(self, i):
        return [k for k, v in self.entry.items() if v == i]

    def create(self, d, name, i, kind, size, mode, uid, gid):
        if self.inode.get(d, {}).get("kind") == "directory" and (d, name) not in self.entry:
            self.entry[d, name] = i
            self.inode[i] = dict(kind=kind, size=size, mode=mode, uid=uid, gid=gid, parent=d, name=name)

    def link(self, d, name, i):
        x = self.inode.get(i)
        if x and x["kind"] != "directory" and i not in self.orphans and self.inode.get(d, {}).get("kind") == "directory" and (d, name) not in self.entry:
            self.entry[d, name] = i
            x.update(parent=None, name=None)

    def remove(self, d, name, opened, now, full):
        i = self.entry.get((d, name))
        if i is None or i in full:
            return
        del self.entry[d, name]
        if not self.names(i):
            if i in opened:
                self.orphans.add(i)
                return
            x = self.inode.pop(i)
            if x["kind"] == "file" and x["size"]:
                self.stones[i] = (now, x["size"])

    def rename(self, d, name, to, new):
        i = self.entry.get((d, name))
        if i is None or (to, new) in self.entry or self.inode.get(to, {}).get("kind") != "directory" or (self.inode[i]["kind"] == "directory" and self.below(to, i)):
            return False
        del self.entry[d, name]
        self.entry[to, new] = i
        if self.inode[i]["parent"] is not None:
            self.inode[i].update(parent=to, name=new)
        return True


def checked(tables, model):
    """The tables say what the model says, and every audit is content."""
    tables = {k: v.sparkSession.createDataFrame(v.collect(), SCHEMAS[k]) for k, v in tables.items()}
    assert {(r.dir_id, r.name): r.inode_id for r in tables["dir_entry"].collect()} == model.entry
    got = {r.inode_id: r for r in tables["inode"].collect()}
    assert {i: dict(kind=r.kind, size=r["size"], mode=r["mode"], uid=r.uid, gid=r.gid, parent=r.parent, name=r["name"]) for i, r in got.items()} == model.inode
    assert {r.inode_id for r in tables["orphan"].collect()} == model.orphans and {r.inode_id: (r.ts, r.remaining_size) for r in tables["tombstone"].collect()} == model.stones
    inode, entry, scan = tables["inode"], tables["dir_entry"], tables["dir_scan"]
    bad = [
        audit.dangling_entries(entry, inode), audit.entry_counts(inode, entry), audit.link_counts(inode, entry), audit.unreferenced(inode, entry, tables["orphan"]), audit.live_tombstones(tables["tombstone"], inode), audit.directory_links(inode, entry),
        audit.stale_embedded(scan, inode), audit.cookie_counters(tables["dir_cookie"], entry), audit.not_directories(entry, inode), audit.not_directories(scan, inode), audit.not_directories(tables["dir_cookie"], inode), liveness.scan_consistency(entry, scan),
    ]
    assert [x.count() for x in bad] == [0] * len(bad)
    used = tables["stats_shard"].agg(F.sum("used_bytes"), F.sum("used_inodes")).first()
    assert tuple(used) == (sum(x["size"] for x in model.inode.values() if x["kind"] == "file"), len(model.inode) - 1)
    return tables


@pytest.fixture(scope="module")
def start(spark):
    empty = {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    return {**empty, "inode": spark.createDataFrame([(0, "directory", 0, 493, 0, 0, 2, 0, None, 0, 0)], SCHEMAS["inode"]), "stats_shard": spark.createDataFrame([(0, 0, 0)], SCHEMAS["stats_shard"])}


def test_batches_against_single_operations(spark, start):
    draw, model, tables = random.Random(6), Model(), start
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    for batch in range(2):
        # directories of the batch before may be used
        dirs = [i for i, x in model.inode.items() if x["kind"] == "directory"]
        new = [(draw.choice([*dirs, 999]), f"n{batch}{draw.randrange(40)}", 1000 * batch + k + 1, draw.choice(["file", "directory", "symlink", "fifo"]), draw.choice([0, 10, 5000]), 420, draw.randrange(3), 0) for k in range(25)]
        new = list({x[:2]: (*x[:4], x[4] if x[3] in ("file", "symlink") else 0, *x[5:]) for x in new}.values())
        tables = transact.apply(tables, transact.create(tables, table(new, "dir_id long, name string, inode_id long, kind string, size long, mode long, uid long, gid long"), batch))
        for x in new:
            model.create(*x)
        tables = checked(tables, model)
    dirs, files = ([i for i, x in model.inode.items() if (x["kind"] == "directory") == d] for d in (True, False))
    links = [(draw.choice(dirs), f"l{k}", draw.choice([*files, dirs[1]])) for k in range(12)]
    tables = transact.apply(tables, transact.link(tables, table(links, "dir_id long, name string, inode_id long")))
    for x in links:
        model.link(*x)
    tables = checked(tables, model)
    moves = [(*k, draw.choice(dirs), f"m{n}") for n, k in enumerate(draw.sample(sorted(model.entry), 14)) if model.inode[model.entry[k]]["kind"] != "directory"]
    folder = next(d for d in dirs if d and any(model.inode[e]["kind"] != "directory" for (p, _), e in model.entry.items() if p == d))
    place = (model.inode[folder]["parent"], model.inode[folder]["name"])
    moves += [(*place, folder, "below-itself"), (0, "nothing", 0, "x")]
    tables = transact.apply(tables, transact.rename(tables, table(moves, "dir_id long, name string, to_dir long, to_name string")))
    for x in moves:
        model.rename(*x)
    tables = checked(tables, model)
    full = {d for d, _ in model.entry}
    gone = [*draw.sample(sorted(model.entry), 25), (0, "nothing")]
    opened = {model.entry[k] for k in gone[:6] if k in model.entry and model.inode[model.entry[k]]["kind"] != "directory"}
    tables = transact.apply(tables, transact.remove(tables, table(gone, "dir_id long, name string"), table([(i,) for i in opened], "inode_id long"), 77))
    for x in gone:
        model.remove(*x, opened, 77, full)
    assert model.stones and model.orphans
    checked({**tables, "inode": tables["inode"]}, model)


def test_who_may_set_attributes(spark, start):
    new = spark.createDataFrame([(0, "a", 1, "file", 5, 2541, 3, 3), (0, "b", 2, "directory", 0, 493, 3, 3)], "dir_id long, name string, inode_id long, kind string, size long, mode long, uid long, gid long")
    tables = transact.apply(start, transact.create(start, new, 0))
    for who, mode, uid, gid, want in [(3, 420, None, None, (420, 3, 3)), (4, 420, None, None, (2541, 3, 3)), (3, None, 5, None, (2541, 3, 3)), (0, None, 5, None, (2541, 5, 3)), (3, None, None, 9, (2541 & 1023, 3, 9)), (0, 65535, 1, 1, (4095, 1, 1))]:
        asked = spark.createDataFrame([(1, who, mode, uid, gid)], "inode_id long, who long, mode long, uid long, gid long")
        after = transact.apply(tables, transact.set_attributes(tables, asked))
        row = after["inode"].where("inode_id = 1").first()
        assert (row["mode"], row.uid, row.gid) == want
        assert audit.stale_embedded(after["dir_scan"], after["inode"]).count() == 0
