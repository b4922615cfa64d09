"""Source files and the logs beside them: discovery, hashes, languages, git history and changes, traces."""

import fnmatch
import json
import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_FILES, MOST_COMMITS = 512 << 10, 10_000, 200
# Folders, files and extensions that are never read.
IGNORED_FOLDERS = [
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", ".next", ".nuxt", ".context", "__pycache__", ".mypy_cache", ".pytest_cache", "coverage",
    ".nyc_output", ".turbo", ".parcel-cache", "vendor", "target", ".vscode", ".idea", ".fleet", "venv", ".venv", "env", ".env", ".terraform", ".serverless",
]
IGNORED_FILES = [
    ".DS_Store", "Thumbs.db", "desktop.ini", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "Cargo.lock", "go.sum", "Gemfile.lock", "composer.lock", "poetry.lock",
]
IGNORED_EXTENSIONS = [
    "map", "min.js", "min.css", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "bmp", "mp3", "mp4", "wav", "avi", "mov", "mkv", "zip", "tar", "gz", "bz2", "xz", "7z", "rar",
    "woff", "woff2", "ttf", "eot", "otf", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "exe", "dll", "so", "dylib", "o", "obj", "pyc", "pyo", "class", "db", "sqlite", "sqlite3", "wasm",
]
IGNORE_FILES = [".gitignore", ".cbmignore"]
# Languages by extension.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust",
    "java": "java", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php",
}


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(pairs, extension(path))


def skipped(path) -> Column:
    """Whether a path lies in a folder, or is a file, that is never read."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in IGNORED_FOLDERS]))
    return folders | name.isin(IGNORED_FILES) | extension(path).isin(IGNORED_EXTENSIONS) | F.col(path).contains(".claude/worktrees/")


def ignore_regex(patterns: list[str]) -> str | None:
    """Ignore patterns as one regular expression over relative paths; comments and negations do not count."""
    out = []
    for line in patterns:
        p = line.strip()
        if not p or p[0] in "#!":
            continue
        anchored, folder, p = p.startswith("/"), p.endswith("/"), p.strip("/")
        body = re.sub(r"\\\.\\\*|.", lambda m: m.group(), fnmatch.translate(p).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z"))
        body = body.replace(".*", "[^/]*") if "**" not in p else body
        out.append(("^" if anchored or "/" in p else "(^|.*/)") + "(?:" + body + ")" + ("/.*" if folder else "(/.*)?") + "$")
    return "|".join(f"(?:{p})" for p in out) or None


def read_ignores(root: str) -> list[str]:
    out = []
    for name in IGNORE_FILES:
        at = os.path.join(root, name)
        if os.path.isfile(at):
            with open(at, encoding="utf-8", errors="replace") as f:
                out += f.read().splitlines()
    return out


def contained(root: str, path: str) -> bool:
    """Whether a path, links followed, stays inside the root and exists."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    return os.path.exists(real) and (real == base or real.startswith(base + os.sep))


def discover(spark: SparkSession, root: str, ignore: list[str] = (), most_bytes: int = MOST_BYTES, most_files: int | None = MOST_FILES) -> DataFrame:
    """rel_path, size, mtime_ns, content of the source files under a root folder; empty and large files are left out.

    With ``most_files`` the first so many in path order; None lifts it.
    """
    base = root.rstrip("/")
    plain = re.sub(r"^file:/*", "/", base)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(plain).replace("/", "/+") + "/", "")
    files = files.select(rel.alias("rel_path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")
    files = files.where((F.col("size") > 0) & (F.col("size") <= most_bytes) & ~skipped("rel_path"))
    pattern = ignore_regex([*read_ignores(plain), *ignore])
    files = files.where(~F.col("rel_path").rlike(pattern)) if pattern else files
    return files.orderBy("rel_path").limit(most_files) if most_files else files


def hashed(files: DataFrame) -> DataFrame:
    """Discovered files with text, content_hash and language."""
    return files.select("rel_path", "size", "mtime_ns", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("content_hash"), language(F.col("rel_path")).alias("language"))


def source_lines(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """path, line_no (from 1), line."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split("text", "\n")).alias("_p", "line")).select("path", (F.col("_p") + 1).cast("long").alias("line_no"), "line")


def signature(files: DataFrame, most: int = 2000) -> DataFrame:
    """signature: number of files and sum of their times, over the first ``most`` paths."""
    return files.orderBy("rel_path").limit(most).agg(F.concat_ws(":", F.count(F.lit(1)), F.coalesce(F.sum("mtime_ns"), F.lit(0))).alias("signature"))


def stale(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """rel_path of files whose time or size differs from the catalog, and of files gone."""
    then = hashes.select("rel_path", F.col("mtime_ns").alias("_m"), F.col("size").alias("_s"))
    both = files.select("rel_path", "mtime_ns", "size").join(then, "rel_path", "full_outer")
    return both.where(~(F.col("mtime_ns").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s")))).select("rel_path")


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout


def git_history(spark: SparkSession, root: str, most: int = MOST_COMMITS) -> DataFrame | None:
    """commit, file of the last commits; None where git fails."""
    out = _git(root, "log", "--name-only", f"-{most}", "--pretty=format:%x01")
    if out is None:
        return None
    rows = [(i, f) for i, block in enumerate(out.split("\x01")) for f in block.split("\n") if f.strip()]
    return spark.createDataFrame(rows, "commit int, file string")


def git_changes(spark: SparkSession, root: str, scope: str = "all", base: str = "main") -> DataFrame:
    """path, status (added, deleted, modified) of one scope: unstaged, staged, all or branch; empty where git fails."""
    args = {"unstaged": ["diff"], "staged": ["diff", "--cached"], "all": ["diff", "HEAD"], "branch": ["diff", f"{base}...HEAD"]}[scope]
    out, rows = _git(root, *args, "--name-status") or "", []
    for line in out.splitlines():
        status, _, path = line.partition("\t")
        rows.append((path, {"A": "added", "D": "deleted"}.get(status[:1], "modified")))
    return spark.createDataFrame(rows, "path string, status string")


def last_change(files: DataFrame, root: str | None = None) -> int | None:
    """Epoch milliseconds of the last commit, else of the latest file."""
    out = _git(root, "log", "-1", "--format=%ct") if root else None
    if out and out.strip():
        return int(out) * 1000
    top = files.agg(F.max("mtime_ns")).first()[0]
    return top // 1_000_000 if top is not None else None


TRACE = "array<struct<fromId:string,toId:string,type:string,weight:double>>"


def traces(texts: DataFrame, column: str = "traces") -> DataFrame:
    """source_id, target_id, type, weight from JSON arrays; items without string ends and type are left out."""
    items = texts.select(F.explode(F.from_json(F.col(column), TRACE)).alias("t"))
    rows = items.select(F.col("t.fromId").alias("source_id"), F.col("t.toId").alias("target_id"), F.col("t.type").alias("type"), F.col("t.weight").alias("weight"))
    return rows.where("source_id IS NOT NULL AND target_id IS NOT NULL AND type IS NOT NULL")


def parse_traces(spark: SparkSession, text: str) -> DataFrame:
    """Traces given as one JSON text; anything but an array raises."""
    if not isinstance(json.loads(text), list):
        raise ValueError("traces must be a JSON array")
    return traces(spark.createDataFrame([(text,)], "traces string"))
