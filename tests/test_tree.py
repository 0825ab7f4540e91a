"""The distributed listing against os.walk."""

import os

import pytest

from quarrylight.sources import scan, tree
from tests.fixtures import make

FILES = {f"{d}{n}": "x\n" for d in ("", "a/", "a/b/", "a/b/c/", "a-b/", "_hidden/", ".dot/deep/", "é/", "node_modules/x/") for n in ("one.py", ".hidden", "_two.txt", "z é.md")}


def by_walk(root: str, rules) -> list:
    rows = []
    for folder, dirs, names in os.walk(root, followlinks=False):
        inside = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if inside == "." else inside + "/"
        dirs[:] = sorted(d for d in dirs if not rules.matches(prefix + d))
        rows += [(prefix + n, os.path.join(folder, n), os.path.islink(os.path.join(folder, n))) for n in sorted(names)]
    return rows


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    out = make(tmp_path_factory.mktemp("tree"), FILES)
    os.symlink(os.path.join(out, "one.py"), os.path.join(out, "a/link.py"))
    os.symlink(os.path.join(out, "a"), os.path.join(out, "linked"))
    os.symlink(os.path.join(out, "nowhere"), os.path.join(out, "broken"))
    return out


def test_same_rows_in_the_same_order(spark, root):
    rules = scan.IgnoreRules.of(["_two.txt"])
    found = [(r.path, r.absolute_path, r.is_link) for r in scan.listed(spark, root, rules).orderBy("seq").collect()]
    assert found == by_walk(root, rules) and len(found) == 34
    assert {r.path for r in scan.listed(spark, root, rules).where("ignored").collect()} == {p for p, *_ in found if p.endswith("_two.txt")}


@pytest.mark.parametrize("parts, depth", [(1, 1), (5, 1), (7, 2), (3, 9)])
def test_partitions_share_the_tree(root, parts, depth):
    rules = scan.IgnoreRules.of([])
    found = [x[:3] for k in range(parts) for x in tree.walk(root, k, parts, depth, rules.regex.replace(r"\z", r"\Z"))]
    assert sorted(found) == sorted(by_walk(root, rules)) and len(set(found)) == len(found)


def test_other_file_systems_and_missing_folders(spark, root):
    assert list(tree.walk(os.path.join(root, "none"), 0, 1, 2, None)) == []
    assert scan._content("", os.path.join(root, "none")) == (None, None)
    assert scan._content("file://" + root, os.path.join(root, "one.py")) == (b"x\n", 2)
    assert [x[:2] for x in tree.walk(f"file://{root}/a/b/c", 0, 1, 2, None) if x[0] == "one.py"] == [("one.py", f"{root}/a/b/c/one.py")]
