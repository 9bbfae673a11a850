"""The index and the commits of repositories that git makes here, read without it."""

import json
import os
import shutil
import subprocess

import pytest

from prosemetrics.cli import run
from prosemetrics.sources import git_tree

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git makes the repositories")


def git(root, *args):
    who = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_NOSYSTEM": "1"}
    return subprocess.run(["git", *args], cwd=root, env=os.environ | who, check=True, capture_output=True, text=True).stdout


def put(root, path, text):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture()
def repository(tmp_path):
    git(tmp_path, "init", "-q")
    for path, text in {
        "kept.md": "It ran.", "changed.md": "It is very big.", "moved.md": "It was here.", "gone.md": "It is gone.", "worse.md": "It ran.", "deep/er/a b ä.md": "Old.", "mode.sh": "true", "bytes.bin": b"\xff\xfe\x00",
    }.items():
        put(tmp_path, path, text)
    for i in range(60):  # long and alike, so that a pack holds differences
        put(tmp_path, f"many/{i}.txt", "\n".join(f"line {j} of all" for j in range(300)) + f"\nfile {i}\n" * (i % 7))
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "first")
    return tmp_path


def change(root):
    put(root, "changed.md", "It is big.")
    put(root, "deep/er/a b ä.md", "New ß.")
    put(root, "worse.md", "It is a robust and seamless thing.")
    put(root, "new/one.md", "It is new.")
    put(root, "bytes.bin", b"\xff\x00\x01")
    git(root, "mv", "moved.md", "deep/moved.md")
    git(root, "rm", "-q", "gone.md")
    os.chmod(root / "mode.sh", 0o755)
    git(root, "add", "-A")
    put(root, "kept.md", "Changed in the tree, not in the index.")
    put(root, "untracked.md", "Not staged.")
    put(root, "meant.md", "Only meant to be added.")
    git(root, "add", "-N", "meant.md")


WANT = {
    "changed.md": ("modified", None, "It is very big.", "It is big."), "deep/er/a b ä.md": ("modified", None, "Old.", "New ß."), "worse.md": ("modified", None, "It ran.", "It is a robust and seamless thing."),
    "new/one.md": ("added", None, None, "It is new."), "bytes.bin": ("modified", None, None, None), "deep/moved.md": ("renamed", "moved.md", "It was here.", "It was here."),
    "moved.md": ("deleted", None, "It was here.", None), "gone.md": ("deleted", None, "It is gone.", None), "mode.sh": ("modified", None, "true", "true"),
}


def rows(df):
    return {r["path"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("packed, version", [(False, 2), (True, 4)])
def test_staged(spark, repository, packed, version):
    if packed:
        git(repository, "gc", "-q", "--aggressive")
        git(repository, "pack-refs", "--all")
    change(repository)
    git(repository, "update-index", "--index-version", str(version))
    assert rows(git_tree.staged(spark, str(repository))) == WANT
    shown = {tuple(x.split("\t")) for x in git(repository, "-c", "core.quotePath=false", "diff", "--cached", "--name-status", "--no-renames").splitlines()}
    got = {(s[0].upper().replace("R", "A"), p) for p, (s, *_) in WANT.items()}
    assert shown == got


def test_entries_and_objects_are_those_of_git(spark, repository):
    git(repository, "gc", "-q", "--aggressive")
    put(repository, "worse.md", "Second.")
    git(repository, "commit", "-qam", "second")
    git(repository, "tag", "-am", "x", "v2")
    for tree in ("HEAD", "HEAD~1", "v2"):
        listed = {tuple(x.split(" ", 2)[0:1]) + tuple(x.split(" ", 2)[2].split("\t")) for x in git(repository, "-c", "core.quotePath=false", "ls-tree", "-r", tree).splitlines()}
        name = git(repository, "rev-parse", tree).strip() if "~" in tree else tree
        assert {(f"{r['mode']:06o}", r["oid"], r["path"]) for r in git_tree.entries(spark, str(repository), name).collect()} == listed
    store = git_tree.Repository(str(repository))
    for path, _, oid in store.index():
        raw = subprocess.run(["git", "cat-file", "blob", oid], cwd=repository, check=True, capture_output=True).stdout
        assert store.read(oid) == ("blob", raw), path
    with pytest.raises(ValueError):
        store.commit_of("nowhere")
    with pytest.raises(KeyError):
        store.read("0" * 40)


def test_before_the_first_commit_and_worktrees(spark, repository, tmp_path_factory):
    fresh = tmp_path_factory.mktemp("fresh")
    git(fresh, "init", "-q")
    assert git_tree.staged(spark, str(fresh)).collect() == []
    put(fresh, "a.md", "It ran.")
    git(fresh, "add", "a.md")
    assert rows(git_tree.staged(spark, str(fresh))) == {"a.md": ("added", None, None, "It ran.")}
    tree = tmp_path_factory.mktemp("trees") / "w"
    git(repository, "worktree", "add", "-q", str(tree))
    put(tree, "kept.md", "It runs.")
    git(tree, "add", "-A")
    assert rows(git_tree.staged(spark, str(tree))) == {"kept.md": ("modified", None, "It ran.", "It runs.")}
    with pytest.raises(ValueError):
        git_tree.Repository(str(tmp_path_factory.mktemp("no")))


def test_commit_decisions(spark, repository):
    change(repository)
    overrides = spark.createDataFrame([("marketing_adjective", None, "action", "block")], "check_id string, glob string, field string, value string")
    rules = [{"glob": "*.md", "ruleset": "prose"}]
    decided = git_tree.commit_decisions(spark, str(repository), rules, overrides=overrides).collect()
    got = {r["path"]: (r["decision"], r["before_weight"], r["after_weight"]) for r in decided}
    assert got["worse.md"] == ("deny", 0, 2) and got["changed.md"][0] == "clean" and got["new/one.md"][0] == "clean"
    assert "deep/moved.md" not in got and "kept.md" not in got and got["mode.sh"][0] == "out_of_scope"


def test_precommit_of_a_repository(spark, repository, tmp_path_factory, capsys):
    change(repository)
    conf = tmp_path_factory.mktemp("conf") / "c.json"
    conf.write_text(json.dumps({"rulesets": [{"glob": "*.md", "ruleset": "prose"}], "check_config": {"prose": {"marketing_adjective": {"action": "block"}}}}))
    assert run(["precommit", str(repository), "--rules", str(conf), "--json"], spark) == 1
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["path"], r["before_weight"], r["after_weight"], r["flags"]) for r in shown] == [("worse.md", 0, 2, 2)] and "[marketing_adjective] robust" in shown[0]["shown"]
