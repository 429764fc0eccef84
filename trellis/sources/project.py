"""The files around a graph: root search, listings with ignore rules, hashes, stored states, and git snapshots.

Names, sizes and times of files come from the tree source, contents are read where tasks run, through the same URIs.
"""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import subprocess
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import _where, gone_at_exit, shared_dir
from . import directory
from .tables import GraphTables
from .tree import contents, opened, tree, uri

IGNORE, STATE = ".gitignore", ".drift-state"
_PIECE = 1 << 20


def find_root(start: str, name: str) -> str:
    """The directory ``name`` in ``start`` or the nearest directory above it."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / name).exists():
            if not (folder / name).is_dir():
                raise ValueError(f"{folder / name} exists but is not a directory")
            return str(folder / name)
    raise FileNotFoundError(f"no {name} directory here or above {start}")


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of every regular file below ``root``, listed by tasks whenever it is evaluated; mtime in milliseconds."""
    return tree(spark, root).where("not folder").select("path", "mtime", "size")


def _pattern(body: str) -> str:
    """An ignore pattern as a regular expression over a relative path."""
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@lru_cache(4096)
def rules(text: str) -> tuple[tuple[bool, re.Pattern], ...]:
    """(negated, pattern) of an ignore file, in order. A pattern with a slash before its end hangs on the file's directory."""
    out = []
    for line in text.split("\n"):
        line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        directory_only = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        core = _pattern(body.lstrip("/"))
        out.append((negated, re.compile(("" if anchored else "(?:.*/)?") + core + ("/" if directory_only else "/?"), re.S)))
    return tuple(out)


def ignores(text: str, path: str) -> bool:
    """Whether the ignore file's rules leave out a path relative to its directory. A name counts as file and as directory,
    so a directory pattern leaves out a file of that name too; what lies in a directory left out is out as well."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        here = "/".join(parts[:i])
        for as_path in (here, here + "/"):
            verdict = False
            for negated, pattern in rules(text):
                if pattern.fullmatch(as_path):
                    verdict = not negated
            if verdict:
                return True
    return False


def ignore_files(spark: SparkSession, root: str, files: DataFrame) -> dict[str, str]:
    """Text of each ignore file by its directory; read by the driver, as there are few and small."""
    top, out = uri(spark, root), {}
    for (path,) in files.where((F.col("path") == IGNORE) | F.col("path").endswith("/" + IGNORE)).select("path").collect():
        where, at = opened(f"{top}/{path}")
        with where.open_input_stream(at, compression=None) as f:
            out[path[: -len(IGNORE)].rstrip("/")] = f.read().decode("utf-8", "replace")
    return out


def _kept(mapping: str, path: str, found: dict[str, str]) -> bool:
    """Whether a scan of the directory ``mapping`` takes a file below it: the root's ignore file and those from the mapping down count."""
    if path == mapping:
        return True
    for folder, text in found.items():
        if folder == "" or folder == mapping or folder.startswith(mapping + "/"):
            inside = path[len(folder) + 1 :] if folder else path
            if (not folder or path.startswith(folder + "/")) and ignores(text, inside):
                return False
    return True


def expand(spark: SparkSession, root: str, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tracked, path, category): files that tracked paths (node, path, category) stand for. A path is a file, which
    counts whatever the ignore rules, or a directory, whose files count by the rules. Paths that do not exist give none."""
    found = spark.sparkContext.broadcast(ignore_files(spark, root, files))
    from ..functions.text import prefixes

    below = files.select("path", F.explode(prefixes("path")).alias("tracked"))
    hit = below.join(wanted.select(F.col("path").alias("tracked")).distinct(), "tracked")

    def run(batches):
        for b in batches:
            keep = [_kept(t, p, found.value) for t, p in zip(b["tracked"].to_pylist(), b["path"].to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    hit = hit.select("tracked", "path").mapInArrow(run, "tracked string, path string")
    return wanted.select("node", F.rtrim(F.col("path")).alias("tracked"), "category").join(hit, "tracked").select("node", "tracked", "path", "category")


def anchor_texts(spark: SparkSession, root: str, files: DataFrame, mappings: DataFrame) -> DataFrame:
    """(node, content) of files that mappings stand for, for anchors: no ignore rules, but nothing whose name starts with
    '.' and no node_modules below a mapped directory."""
    from ..functions.text import prefixes

    below = files.select("path", F.explode(prefixes("path")).alias("mapping")).join(mappings.select("node", "mapping"), "mapping")
    inside = F.expr("substring(path, length(mapping) + 1)")
    below = below.where((F.col("path") == F.col("mapping")) | ~inside.rlike(r"/(\.|node_modules(/|$))")).select("node", "path").distinct()
    return contents(spark, root, below).select("node", F.decode("content", "UTF-8").alias("content"))


def hash_files(spark: SparkSession, root: str, files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(path, hash, mtime) of ``files`` (path, mtime): SHA-256 of the content, each file once.

    ``stored`` (path, hash, mtime): a file whose time is that stored keeps its stored hash unread, even if its bytes differ.
    """
    top = uri(spark, root)
    files = files.select("path", "mtime").distinct()
    known = None
    if stored is not None:
        old = stored.where("hash is not null and mtime is not null").groupBy("path", "mtime").agg(F.min("hash").alias("hash"))
        known = files.join(old, ["path", "mtime"]).select("path", "hash", "mtime")
        files = files.join(old, ["path", "mtime"], "left_anti").select("path", "mtime")

    def run(batches):
        for b in batches:
            hashes = []
            for path in b["path"].to_pylist():
                where, at = opened(f"{top}/{path}")
                h = hashlib.sha256()
                with where.open_input_stream(at, compression=None) as f:
                    while piece := f.read(_PIECE):
                        h.update(piece)
                hashes.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(hashes, pa.string()), b["mtime"]], ["path", "hash", "mtime"])

    fresh = files.mapInArrow(run, "path string, hash string, mtime double")
    return fresh if known is None else fresh.unionAll(known)


STATE_COLS = "node string, hash string, files map<string,string>, mtimes map<string,double>"


def read_state(spark: SparkSession, graph: str) -> DataFrame:
    """(node, hash, files, mtimes) of the stored state: a JSON file for each node. Unreadable ones have no row. A single
    file of an older layout is read, and rewritten as one file for each node: all of these are written before the
    old file moves aside, and it goes last, so a break at any point loses nothing; the next read goes on from there."""
    top = f"{uri(spark, graph)}/{STATE}"
    where, at = opened(top)
    kind = lambda path: where.get_file_info(path).type
    new, old = f"{at}.new", f"{at}.old"
    if kind(at) == fs.FileType.NotFound and kind(old) == fs.FileType.File:
        where.move(new if kind(new) == fs.FileType.Directory else old, at)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return spark.createDataFrame([], STATE_COLS)
    if info.type == fs.FileType.File:
        with where.open_input_stream(at, compression=None) as f:
            text = f.read().decode("utf-8", "replace")
        try:
            raw = json.loads(text)
        except ValueError:
            raw = directory.yaml.safe_load(text) if directory.yaml else None
        entries = {k: v for k, v in raw.items() if isinstance(v, dict) and "hash" in v} if isinstance(raw, dict) else {}
        state = spark.createDataFrame([(k, v["hash"], v.get("files") or {}, {p: float(t) for p, t in (v.get("mtimes") or {}).items()}) for k, v in entries.items()], STATE_COLS)
        if kind(new) == fs.FileType.Directory:
            where.delete_dir(new)
        where.create_dir(new)
        write_state(state, graph, f"{STATE}.new")
        where.move(at, old)
        where.move(new, at)
        where.delete_file(old)
        return state
    if kind(old) == fs.FileType.File:
        where.delete_file(old)
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(top, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = F.from_json("value", "hash string, files map<string,string>, mtimes map<string,double>")
    node = F.regexp_replace(F.url_decode(F.element_at(F.split("file", "/" + re.escape(STATE) + "/"), -1)), r"\.json$", "")
    return text.select(node.alias("node"), parsed.alias("s")).where("s.hash is not null").select("node", "s.hash", "s.files", "s.mtimes")


def write_state(state: DataFrame, graph: str, folder: str = STATE) -> int:
    """Writes a JSON file for each row of ``state``, in nested directories; returns their number. A file is written under a
    name of its attempt and then takes its place, so a lost task leaves the old one whole."""
    top = f"{uri(state.sparkSession, graph)}/{folder}"

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                where, at = opened(f"{top}/{r['node']}.json")
                where.create_dir(at.rpartition("/")[0], recursive=True)
                attempt = f"{at}.{uuid.uuid4().hex}"
                with where.open_output_stream(attempt, compression=None) as f:
                    f.write((json.dumps({"hash": r["hash"], "files": dict(r["files"] or []), "mtimes": dict(r["mtimes"] or [])}, indent=2, ensure_ascii=False) + "\n").encode())
                where.move(attempt, at)
            yield pa.RecordBatch.from_arrays([b["node"]], ["node"])

    return state.select("node", "hash", "files", "mtimes").mapInArrow(run, "node string").count()


def collect_garbage(spark: SparkSession, graph: str, valid: DataFrame) -> list[str]:
    """Removes the stored state of nodes that are not in ``valid`` (node), and directories left empty; the nodes, sorted."""
    top = f"{uri(spark, graph)}/{STATE}"
    where, at = opened(top)
    listed = [f.path[len(at) + 1 : -5] for f in where.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(".json")]
    gone = spark.createDataFrame([(n,) for n in listed], "node string").join(valid.select("node").distinct(), "node", "left_anti")
    removed = sorted(r[0] for r in gone.collect())
    for node in removed:
        where.delete_file(f"{at}/{node}.json")
        folder = f"{at}/{node}".rpartition("/")[0]
        while len(folder) > len(at) and not where.get_file_info(fs.FileSelector(folder)):
            where.delete_dir(folder)
            folder = folder.rpartition("/")[0]
    return removed


def _git(project: str, *args: str) -> str | None:
    done = subprocess.run(["git", *args], cwd=project, capture_output=True, text=True)
    return done.stdout if done.returncode == 0 else None


def at_ref(spark: SparkSession, project: str, graph: str, ref: str = "HEAD") -> GraphTables | None:
    """The graph as of a commit; None without a repository, the commit, or the graph in it.

    The driver asks git for the files; on a cluster they go to the shared folder, where tasks read them.
    """
    if ref.startswith("-") or _git(project, "rev-parse", "--verify", ref) is None:
        return None
    folder = tempfile.mkdtemp(prefix="trellis-ref-")
    try:
        packed = f"{folder}/graph.tar"
        if _git(project, "archive", ref, graph, "-o", packed) is None:
            return None
        shutil.unpack_archive(packed, folder, "tar", filter="data")
        place = f"{folder}/{graph}"
        if not spark.sparkContext.master.startswith("local"):
            place = f"{shared_dir(spark)}/ref-{uuid.uuid4().hex}"
            at, files = _where(spark, place)
            files.copyFromLocalFile(_where(spark, f"file://{folder}/{graph}")[0], at)
            gone_at_exit(spark, place)
        return directory.load(spark, place)  # its files are read at once, into written tables
    except (ValueError, OSError, AnalysisException):
        return None
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def changed_files(spark: SparkSession, project: str, graph: str, ref: str = "HEAD") -> DataFrame:
    """(path) of files below the graph directory that differ from a commit, relative to it; none if git fails."""
    out = None if ref.startswith("-") else _git(project, "diff", "--name-only", ref, "--", f"{graph}/")
    names = [x for x in (out or "").split("\n") if x]
    inside = [(n.removeprefix(f"{graph}/").removeprefix("model/"),) for n in names]
    return spark.createDataFrame(inside, "path string")


def last_commit(project: str, path: str) -> int | None:
    """Seconds since 1970 of the last commit that touched a path, or None."""
    out = _git(project, "log", "-1", "--format=%ct", "--", path)
    return int(out) if out and out.strip().isdigit() else None
