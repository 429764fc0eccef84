"""The tree source against a plain walk, with paths that keep directories unlisted."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_directory import project, rows

from trellis.sources import directory, tree

FILES = ["a.txt", ".dot/x/y.txt", "_under/_z.txt", "deep/1/2/3/4/5.txt", "deep/1/b.txt", "flat/" + "n" * 100, "ü/ß.txt", "deep1/c.txt", "a b/50% #1?.txt"] + [f"many/{k}/f{j}" for k in range(30) for j in range(3)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for f in FILES:
        (top / f).parent.mkdir(parents=True, exist_ok=True)
        (top / f).write_text(f)
    (top / "empty" / "er").mkdir(parents=True)
    (top / "loop").symlink_to(top)
    return str(top)


def walked(root):
    out = set()
    for folder, folders, files in os.walk(root):
        at = os.path.relpath(folder, root)
        out |= {(os.path.normpath(os.path.join(at, n)), n in folders) for n in folders + files}
    return out


@pytest.mark.parametrize("tasks", [1, 5, 64])
def test_every_entry_once(spark, root, tasks):
    spark.dataSource.register(tree.TreeSource)
    got = spark.read.format("trellis_tree").option("tasks", tasks).load(root).collect()
    assert sorted((r.path, r.folder) for r in got) == sorted(walked(root))
    for r in got:
        st = os.stat(f"{root}/{r.path}")
        assert (r.dir, r.name) == tuple(r.path.rpartition("/")[::2]) and r.mtime == st.st_mtime_ns // 1_000_000 and r.size == (None if r.folder else st.st_size)


def test_filters_one_after_the_other(spark, root):
    """A filter of one query does not stay for the next one over the same table."""
    everything = tree.tree(spark, root)
    rows_ = everything.collect()
    for cond, plain in [(F.col("path") == "deep/1/b.txt", lambda r: r.path == "deep/1/b.txt"), (F.col("dir") == "", lambda r: r.dir == ""), ((F.col("dir") == "flat") | (F.col("name") == "a.txt"), lambda r: r.dir == "flat" or r.name == "a.txt")]:
        assert sorted(r.path for r in everything.where(cond).collect()) == sorted(r.path for r in rows_ if plain(r))
    assert everything.count() == len(rows_)


@pytest.mark.parametrize("at", [["deep"], ["deep/1/b.txt", "flat"], ["many/3", "many/3/f1", "none/x"], ["ü/"], [""], []])
def test_paths(spark, root, at):
    keep = lambda p: any(not a or p == a.strip("/") or p.startswith(a.strip("/") + "/") for a in at)
    assert sorted(r.path for r in tree.tree(spark, root, at).collect()) == sorted(p for p, _ in walked(root) if keep(p))


def test_what_cannot_hold_a_hit_is_not_listed(root, monkeypatch):
    listed = []

    class Seen:
        type_name = "local"

        def __init__(self, inner):
            self.inner = inner

        def get_file_info(self, what):
            if not isinstance(what, str):
                listed.append(os.path.relpath(what.base_dir, root))
            return self.inner.get_file_info(what)

    real = tree.opened
    monkeypatch.setattr(tree, "opened", lambda w: (Seen(real(w)[0]), real(w)[1]))
    for at, want in [(["deep/1/2"], {".", "deep", "deep/1", "deep/1/2", "deep/1/2/3", "deep/1/2/3/4"}), (["deep/1/b.txt"], {".", "deep", "deep/1"}), (["a.txt", "flat"], {".", "flat"})]:
        reader = tree.TreeReader(root, 3, at)
        listed.clear()
        for p in reader.partitions():
            list(reader.read(p))
        assert set(listed) == want


def test_roots_without_rows(spark, root, tmp_path):
    assert tree.tree(spark, str(tmp_path / "none")).isEmpty() and tree.tree(spark, f"{root}/a.txt").isEmpty() and tree.tree(spark, str(tmp_path)).isEmpty()


def test_contents_leave_out_what_went(spark, root):
    some = spark.createDataFrame([("a.txt", 1), ("gone", 2), ("ü/ß.txt", 3), ("a b/50% #1?.txt", 4)], "path string, k int")
    assert sorted((r.k, bytes(r.content).decode()) for r in tree.contents(spark, root, some).collect()) == [(1, "a.txt"), (3, "ü/ß.txt"), (4, "a b/50% #1?.txt")]


def test_graph_directories_by_the_tree(spark, tmp_path):
    """Underscore names are nodes, directories with a dot are not entered, empty directories are seen."""
    top = project(tmp_path, **{"model/_base/yg-node.yaml": "name: B\ntype: module\n", "model/_base/.old/yg-node.yaml": "name: O\ntype: module\n", "aspects/.draft/yg-aspect.yaml": "x: 1\n", "aspects/_own/yg-aspect.yaml": "name: Own\n", "model/_base/.notes/a.md": "x"})
    Path(top, "model/hull/keel").mkdir(parents=True)
    Path(top, "model/mast/.git").mkdir(parents=True)
    g = directory.load(spark, top)
    assert [r[0] for r in rows(g.nodes, "path")] == ["_base", "auth", "auth/api"]
    assert [r[0] for r in rows(g.aspects, "id")] == ["_own", "audit", "audit/logging"]
    assert rows(g.without_node, "dir", "code") == [("deep", "W013"), ("hull", "W013"), ("orphan", "E015")]
