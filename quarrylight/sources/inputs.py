"""Repository inputs: directories, ZIP files and GitHub URLs, prepared on the driver."""

from __future__ import annotations

import os
import re
import shutil
import stat
import subprocess
import tempfile
import zipfile
from dataclasses import dataclass
from enum import Enum
from pathlib import Path, PurePosixPath


class InputError(ValueError):
    """An input that can't be used; `code` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class InputKind(Enum):
    LOCAL = "local"
    ZIP = "zip"
    GITHUB = "github"


@dataclass
class Prepared:
    """A directory to index, and the workspace to remove afterwards, if it is ours."""

    root: Path
    kind: InputKind
    source: str
    workspace: Path | None = None

    def __enter__(self) -> Prepared:
        return self

    def __exit__(self, *_) -> None:
        self.cleanup()

    def cleanup(self) -> None:
        if self.workspace is not None and self.workspace.name.startswith(_OWN) and not self.workspace.is_symlink():
            shutil.rmtree(self.workspace, ignore_errors=True)
            self.workspace = None


_OWN = "quarrylight-input-"
_GITHUB = re.compile(r"https?://(?:www\.)?github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)/([A-Za-z0-9._-]+?)(?:\.git)?/?", re.I)
_SCHEME = re.compile(r"[a-z][a-z0-9+.-]*://|[^/@\s]+@[^/:\s]+:", re.I)

# Limits of archives.
MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY, MAX_RATIO = 10_000, 500 << 20, 100 << 20, 100
CLONE_SECONDS = 300


def parse_github_url(url: str) -> tuple[str, str] | None:
    """Owner and repository of a GitHub URL."""
    found = _GITHUB.fullmatch(url.strip())
    return (found[1], found[2]) if found and found[2] not in (".", "..") else None


def normalize_github_url(url: str) -> str:
    found = parse_github_url(url)
    if found is None:
        raise InputError("invalid_github_url", f"Not a GitHub repository URL: {url}")
    return f"https://github.com/{found[0]}/{found[1]}.git"


def classify(source: str) -> InputKind:
    """What a source string names; everything that can't be indexed has its own error."""
    source = source.strip()
    if not source:
        raise InputError("empty_source", "The source is empty.")
    if parse_github_url(source):
        return InputKind.GITHUB
    if _SCHEME.match(source):
        raise InputError("unsupported_url", f"Only GitHub URLs can be cloned: {source}")
    path = Path(source)
    if not path.exists():
        raise InputError("missing_path", f"No such path: {source}")
    if path.is_dir():
        return InputKind.LOCAL
    if path.suffix.lower() == ".zip":
        return InputKind.ZIP
    raise InputError("unsupported_file", f"Neither a directory nor a ZIP file: {source}")


def prepare_local(source: str) -> Prepared:
    root = Path(source.strip()).expanduser().resolve()
    if not root.exists():
        raise InputError("missing_path", f"No such path: {source}")
    if not root.is_dir():
        raise InputError("not_a_directory", f"Not a directory: {source}")
    if not os.access(root, os.R_OK | os.X_OK):
        raise InputError("unreadable", f"Can't be read: {source}")
    return Prepared(root, InputKind.LOCAL, source)


def _entry_problem(info: zipfile.ZipInfo) -> str | None:
    """Why an entry isn't safe to extract."""
    name = info.filename
    parts = PurePosixPath(name.replace("\\", "/")).parts
    if not name or "\x00" in name:
        return "bad_name"
    if name.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", name):
        return "absolute_path"
    if ".." in parts:
        return "traversal"
    kind = stat.S_IFMT(info.external_attr >> 16)
    if kind and kind not in (stat.S_IFREG, stat.S_IFDIR):
        return "special_entry"
    if info.flag_bits & 1:
        return "encrypted"
    if info.file_size > MAX_ENTRY:
        return "entry_too_large"
    if info.file_size > MAX_RATIO * max(1, info.compress_size):
        return "compression_ratio"
    return None


def check_entries(infos: list[zipfile.ZipInfo]) -> None:
    """Raises on the first entry, or set of entries, that breaks a limit."""
    if len(infos) > MAX_ENTRIES:
        raise InputError("too_many_entries", f"{len(infos)} entries; {MAX_ENTRIES} are allowed")
    if sum(i.file_size for i in infos) > MAX_TOTAL:
        raise InputError("archive_too_large", f"More than {MAX_TOTAL} bytes when extracted")
    files, folders = set(), set()
    for info in infos:
        if problem := _entry_problem(info):
            raise InputError(problem, f"Unsafe entry {info.filename!r}: {problem}")
        path = PurePosixPath(info.filename.replace("\\", "/"))
        key = str(path).casefold()
        if not info.is_dir():
            if key in files:
                raise InputError("duplicate_entry", f"{info.filename!r} is there twice")
            files.add(key)
        else:
            folders.add(key)
        folders.update(str(p).casefold() for p in path.parents if str(p) != ".")
    if both := files & folders:
        raise InputError("file_directory_collision", f"Both file and directory: {sorted(both)[0]!r}")


def _workspace(root: str | None) -> Path:
    return Path(tempfile.mkdtemp(prefix=_OWN, dir=root))


def prepare_zip(source: str, workspace_root: str | None = None) -> Prepared:
    """Checks all entries, then extracts; a single top directory becomes the root."""
    try:
        archive = zipfile.ZipFile(source.strip())
    except (OSError, zipfile.BadZipFile) as e:
        raise InputError("bad_archive", f"Can't be opened as ZIP: {source}") from e
    work = _workspace(workspace_root)
    try:
        with archive:
            check_entries(archive.infolist())
            for info in archive.infolist():
                target = work.joinpath(*PurePosixPath(info.filename.replace("\\", "/")).parts)
                if info.is_dir():
                    target.mkdir(parents=True, exist_ok=True)
                    continue
                target.parent.mkdir(parents=True, exist_ok=True)
                left = info.file_size
                with archive.open(info) as src, target.open("wb") as out:
                    while data := src.read(1 << 20):
                        left -= len(data)
                        if left < 0:
                            raise InputError("entry_too_large", f"{info.filename!r} is longer than it says")
                        out.write(data)
        top = list(work.iterdir())
        root = top[0] if len(top) == 1 and top[0].is_dir() else work
        return Prepared(root, InputKind.ZIP, source, work)
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise


def prepare_github(url: str, ref: str | None = None, workspace_root: str | None = None, run=subprocess.run) -> Prepared:
    """Clones without hooks: a branch or tag at depth 1, a commit in full. `run` is for tests."""
    remote, work = normalize_github_url(url), _workspace(workspace_root)
    target = work / "repository"
    commit = bool(ref and re.fullmatch(r"[0-9a-f]{40}", ref))
    if ref and not commit and (ref.startswith("-") or not re.fullmatch(r"[\w./-]+", ref)):
        shutil.rmtree(work, ignore_errors=True)
        raise InputError("bad_ref", f"Not a branch, tag or commit: {ref!r}")
    git = ["git", "-c", f"core.hooksPath={os.devnull}", "-c", "credential.helper="]
    clone = [*git, "clone", "--no-recurse-submodules", *([] if commit else ["--depth", "1"]), *(["--branch", ref] if ref and not commit else []), "--", remote, str(target)]
    steps = [clone, *([[*git, "-C", str(target), "checkout", "--detach", ref]] if commit else [])]
    try:
        for step in steps:
            done = run(step, capture_output=True, text=True, timeout=CLONE_SECONDS, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
            if done.returncode:
                raise InputError("clone_failed", re.sub(r"//[^/@\s]+@", "//", done.stderr or "")[:500])
        return Prepared(target, InputKind.GITHUB, url, work)
    except subprocess.TimeoutExpired as e:
        shutil.rmtree(work, ignore_errors=True)
        raise InputError("clone_timeout", f"No clone within {CLONE_SECONDS} seconds") from e
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise


def prepare(source: str, *, ref: str | None = None, workspace_root: str | None = None) -> Prepared:
    """Any source as a directory to index."""
    kind = classify(source)
    if ref is not None and kind is not InputKind.GITHUB:
        raise InputError("ref_not_supported", "Only GitHub sources have refs.")
    if kind is InputKind.LOCAL:
        return prepare_local(source)
    return prepare_zip(source, workspace_root) if kind is InputKind.ZIP else prepare_github(source, ref, workspace_root)
