"""History on a hand-built repository, and the end-to-end scan."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from credsift import schemas
from credsift.operators import history
from credsift.operators.together import handed
from credsift.options import ScanOptions
from credsift.plans.scan import scan_entries, scan_repo_history
from credsift.session import folders_made
from credsift.sources.sinks import scan_report, write_report

KEY_ID = "AKIA" + "".join(random.Random(4).choices("BCDFGHJKLMNPQRSTVWXZ23456789", k=16))
DAY = datetime(2026, 1, 1, tzinfo=timezone.utc)

# commit -> (parents, files); c3 removes old.env, c4 merges a side branch
TREES = {
    "c1": ([], {"a.env": "one", "old.env": "gone"}),
    "c2": (["c1"], {"a.env": "two", "old.env": "gone"}),
    "side": (["c1"], {"a.env": "one", "old.env": "gone", "side.env": "side"}),
    "c3": (["c2"], {"a.env": "two"}),
    "c4": (["c3", "side"], {"a.env": "two", "side.env": "side", "logo.png": "two"}),
}
TEXTS = {b: f"cloud.id=AKIA{(b.upper() * 16)[-16:]}" for b in ("one", "two", "gone", "side")}


@pytest.fixture(scope="module")
def repo(spark):
    commits = [
        ("r", h, parents, f" {h}\n", "Dev", DAY + timedelta(days=i), DAY + timedelta(days=i))
        for i, (h, (parents, _)) in enumerate(TREES.items())
    ]
    refs = [("r", "HEAD", "symbolic", "c4"), ("r", "refs/heads/main", "hash", "c4"), ("r", "refs/heads/s", "hash", "side")]
    files = [("r", h, p, b) for h, (_, tree) in TREES.items() for p, b in tree.items()]
    blobs = [("r", b, len(t), bytearray(t.encode())) for b, t in TEXTS.items()]
    return (
        spark.createDataFrame(refs, schemas.REFS), spark.createDataFrame(commits, schemas.COMMITS),
        spark.createDataFrame(files, schemas.TREE_FILES), spark.createDataFrame(blobs, schemas.BLOBS),
    )


def test_reachable_commits(repo):
    refs, commits, _, _ = repo
    depths = {r.hash: r.depth for r in history.reachable_commits(refs, commits).collect()}
    assert depths == {"c4": 0, "side": 0, "c3": 1, "c1": 1, "c2": 2}
    assert {r.hash for r in history.reachable_commits(refs, commits, 1).collect()} == {"c4", "side"}
    assert history.reachable_commits(refs, commits, None).count() == 5


def test_first_parent(repo):
    _, commits, _, _ = repo
    parents = {r.commit: r.parent for r in history.first_parent(commits).collect()}
    assert parents == {"c1": None, "c2": "c1", "side": "c1", "c3": "c2", "c4": "c3"}
    cut = history.first_parent(commits.where("hash <> 'c1'"))
    assert {r.commit: r.parent for r in cut.collect()}["c2"] is None


def charged(repo, attribution):
    _, commits, tree_files, _ = repo
    return sorted((r.commit, r.path, r.blob) for r in history.history_files(commits, tree_files, attribution).collect())


def test_tree_diff(repo):
    _, commits, tree_files, _ = repo
    diff = history.tree_diff(tree_files, history.first_parent(commits)).collect()
    assert sorted((r.commit, r.path, r.status) for r in diff) == [
        ("c1", "a.env", "A"), ("c1", "old.env", "A"), ("c2", "a.env", "M"), ("c3", "old.env", "D"),
        ("c4", "logo.png", "A"), ("c4", "side.env", "A"), ("side", "side.env", "A"),
    ]


def test_attribution(repo):
    assert charged(repo, "introducing") == [
        ("c1", "a.env", "one"), ("c1", "old.env", "gone"), ("c2", "a.env", "two"),
        ("c4", "side.env", "side"), ("side", "side.env", "side"),
    ]
    # the blobs that a commit replaced or removed; the root commit has none
    assert charged(repo, "replacing") == [("c2", "a.env", "one"), ("c3", "old.env", "gone")]
    with pytest.raises(ValueError):
        charged(repo, "both")


def test_entry_order(repo):
    refs, commits, tree_files, _ = repo
    files = history.walk(refs, commits, tree_files)[1].orderBy("entry_seq").collect()
    assert [(r.commit, r.path, r.from_history) for r in files] == [
        ("c4", "side.env", True), ("side", "side.env", True), ("c2", "a.env", True), ("c1", "a.env", True),
        ("c1", "old.env", True), ("c4", "a.env", False), ("c4", "side.env", False),
    ]


def test_scan_by_blob_equals_scan_by_entry(repo):
    for attribution in ("introducing", "replacing"):
        options = ScanOptions(attribution=attribution)
        by_blob = scan_repo_history(*repo, options=options).findings
        by_entry = scan_entries(history.repository_entries(*repo, options), options=options)
        assert sorted(by_blob.collect()) == sorted(by_entry.select(by_blob.columns).collect())


def test_findings_name_the_introducing_commit(repo):
    result = scan_repo_history(*repo)
    got = {(r.file, r.matched_value[4:-4], r.commit, r.commit_message) for r in result.findings.collect()}
    stars = "*" * 12
    assert got == {
        ("side.env", stars, "c4", "c4"), ("a.env", stars, "c2", "c2"), ("a.env", stars, "c1", "c1"),
        ("old.env", stars, "c1", "c1"),
    }
    assert [tuple(r) for r in result.stats.collect()] == [("r", 5, 3, result.findings.count())]


def test_history_and_head_entries(repo):
    refs, commits, tree_files, blobs = repo
    head = history.head_entries(refs, commits, tree_files, blobs).collect()
    assert sorted((r.path, bytes(r.content).decode(), r.commit) for r in head) == [
        ("a.env", TEXTS["two"], "c4"), ("side.env", TEXTS["side"], "c4")
    ]
    past = history.history_entries(refs, commits, tree_files, blobs)
    assert past.columns == schemas.ENTRIES.names and past.count() == 5


def test_blob_filters_and_entry_cap(spark, repo):
    refs, commits, tree_files, blobs = repo
    large = blobs.withColumn("size", F.when(F.col("blob") == "two", 2 << 20).otherwise(F.col("size")))
    binary = large.withColumn(
        "content", F.when(F.col("blob") == "side", F.concat("content", F.lit(b"\x00"))).otherwise(F.col("content"))
    )
    kept = history.repository_entries(refs, commits, tree_files, binary)
    assert {r.path for r in kept.collect()} == {"a.env", "old.env"}
    capped = history.repository_entries(refs, commits, tree_files, blobs, ScanOptions(max_entries=3)).collect()
    assert sorted((r.commit, r.path) for r in capped) == [("c2", "a.env"), ("c4", "side.env"), ("side", "side.env")]


def test_latest_commits(repo):
    _, commits, _, _ = repo
    by_ref = commits.select("repo", F.lit("main").alias("ref"), "hash", "committer_when")
    assert [r.hash for r in history.latest_commits(by_ref, 2).orderBy("rank").collect()] == ["c4", "c3"]


def test_full_run(spark, tmp_path):
    """One commit of some files: what is found, what is skipped, and the report."""
    token = "ghp_" + "".join(random.Random(5).choices("bcdfghjkmnpqrstvwxzBCDFGHJK23456789", k=36))
    tree = {
        "ops/run.cfg": f"# keys\nid={KEY_ID}\n", "ops/push.ps1": f"$t = '{token}'\n", "notes.rst": "password: changeme\n",
        "logo.svg": KEY_ID, "src/main.c": "int main(void) { return 0; }\n", "poetry.lock": KEY_ID,
    }
    when = datetime(2031, 7, 8, 9, 10, 11, tzinfo=timezone.utc)
    repo_url = "https://github.com/ada/engine.git"
    result = scan_repo_history(
        spark.createDataFrame([(repo_url, "HEAD", "symbolic", "h"), (repo_url, "trunk", "hash", "h"),
                               ("https://github.com/ada/blank", "trunk", "hash", "e")], schemas.REFS),
        spark.createDataFrame([(repo_url, "h", [], "first import\n\n", "Ada", when, when),
                               ("https://github.com/ada/blank", "e", [], "m", "A", when, when)], schemas.COMMITS),
        spark.createDataFrame([(repo_url, "h", p, p) for p in tree], schemas.TREE_FILES),
        spark.createDataFrame([(repo_url, p, len(t), bytearray(t.encode())) for p, t in tree.items()], schemas.BLOBS),
    )
    report = scan_report(result.findings, result.stats, when)
    write_report(report, str(tmp_path / "report"))
    full, empty = sorted(report.collect(), key=lambda r: r.repo_url, reverse=True)
    assert full.repo_url == "https://github.com/ada/engine"
    assert tuple(full.stats) == (1, 4, 2) and tuple(empty.stats) == (1, 0, 0) and empty.findings == []
    assert [(f.file, f.type, f.line) for f in full.findings] == [("ops/push.ps1", "github_pat", 1), ("ops/run.cfg", "aws_access_key_id", 2)]
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("*.json"))
    assert KEY_ID not in text and token not in text and '"findings":[]' in text
    for f in full.findings:
        assert "*" in f.matched_value and f.commit == "h" and f.commit_author == "Ada"
        assert f.commit_date == when.replace(tzinfo=None) and f.commit_message == "first import"


def test_long_and_branched_histories(spark):
    """Least depths against a breadth-first walk, with and without a bound."""
    rnd = random.Random(6)
    parents = {0: []}
    for i in range(1, 220):
        parents[i] = sorted({i - 1, *([rnd.randrange(max(0, i - 40), i)] if i % 9 == 0 else [])}, reverse=True)
    parents[500], parents[501] = [], [500, 10**6]  # a second root; a parent that is not there
    tips = [219, 150, 501]
    commits = spark.createDataFrame(
        [("r", str(h), [str(p) for p in ps], "m", "A", DAY, DAY) for h, ps in parents.items()], schemas.COMMITS
    )
    refs = spark.createDataFrame([("r", f"b{t}", "hash", str(t)) for t in tips] + [("r", "HEAD", "symbolic", "219")], schemas.REFS)
    depth, edge = {t: 0 for t in tips}, list(tips)
    while edge:
        edge = [p for h in edge for p in parents[h] if p in parents and depth.setdefault(p, depth[h] + 1) == depth[h] + 1]
        edge = list(dict.fromkeys(edge))
    for bound in (None, 1, 7):
        got = {int(r.hash): r.depth for r in history.reachable_commits(refs, commits, bound).collect()}
        assert got == {h: d for h, d in depth.items() if bound is None or d < bound}


def test_tree_diff_against_sets(spark):
    """Random trees of branched histories, lying together by repository or not, with rows no diff can use."""
    rnd = random.Random(9)
    pairs, files, want = [], [], set()
    for r in range(12):
        trees = {}
        for c in range(25):
            parent = rnd.choice([None, *trees]) if c % 6 else None
            tree = {p: b for p, b in trees.get(parent, {}).items() if rnd.random() > 0.1}
            tree |= {f"p{rnd.randrange(9)}": f"b{rnd.randrange(5)}" for _ in range(rnd.randrange(4))}
            trees[f"c{c}"], old = tree, trees.get(parent, {})
            pairs.append((f"r{r}", f"c{c}", parent))
            files += [(f"r{r}", f"c{c}", p, b) for p, b in tree.items()]
            want |= {(f"r{r}", f"c{c}", p, old.get(p), tree.get(p)) for p in {*old, *tree} if old.get(p) != tree.get(p)}
        files.append((f"r{r}", "not reached", "p", "b"))
    files += [(None, "c1", "p", "b"), ("r1", None, "p", "b")]
    pairs += [(None, "c1", None), ("r1", None, None)]
    rows = spark.createDataFrame(files, schemas.TREE_FILES)
    given = spark.createDataFrame(pairs, "repo string, commit string, parent string")
    for trees in (rows, rows.repartition("repo"), rows.repartition(3, "repo"), rows.repartition("repo", "commit")):
        diff = history.tree_diff(trees, given).collect()
        assert len(diff) == len(want)
        assert {(r.repo, r.commit, r.path, r.old_blob, r.new_blob) for r in diff} == want


def dealt_by(df):
    """The columns of each exchange by hash in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#\d+", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]


def test_trees_that_lie_together_are_not_dealt(repo):
    _, commits, tree_files, _ = repo
    pairs = history.first_parent(commits)
    diff = history.tree_diff(tree_files.repartition("repo"), pairs)
    # the trees, the commits they serve, and nothing but what the pairs ask for
    assert sorted(dealt_by(diff)) == sorted([["repo"], ["repo"], *dealt_by(pairs)])


def test_files_that_lie_together_are_not_dealt(spark, repo):
    refs, commits, tree_files, _ = repo
    n = len(folders_made(spark))
    files = history.walk(refs, commits, tree_files.repartition("repo"))[1]
    assert not any({"path", "blob", "tree"} & set(keys) for keys in dealt_by(files))
    assert not any("path" in spark.read.parquet(f).columns for f in folders_made(spark)[n:])
    assert sorted(files.collect()) == sorted(history.walk(refs, commits, tree_files)[1].collect())


@pytest.mark.parametrize("entries", [history.repository_entries, history.history_entries, history.head_entries])
def test_contents_that_lie_together_are_not_dealt(repo, entries):
    refs, commits, tree_files, blobs = repo
    together = entries(refs, commits, tree_files.repartition("repo"), blobs.repartition("repo"))
    assert not any("blob" in keys for keys in dealt_by(together))
    assert sorted(together.collect()) == sorted(entries(*repo).collect())


@pytest.mark.parametrize("options", [ScanOptions(), ScanOptions(max_findings_per_entry=1, max_findings=2, max_entries=6)])
def test_scan_of_what_lies_together(spark, repo, options):
    """The same findings and statistics; no file versions are written, and a report reads the scan once."""
    refs, commits, tree_files, blobs = repo
    # a blob with nothing to see is a file that was scanned; HEAD may stand at a commit that is not listed
    tree_files = tree_files.unionByName(spark.createDataFrame([("r", "c4", "plain.md", "plain"), ("q", "x", "a.env", "one")], schemas.TREE_FILES))
    refs = refs.unionByName(spark.createDataFrame([("q", "HEAD", "symbolic", "x")], schemas.REFS))
    more = [("r", "plain", 5, bytearray(b"plain")), ("q", "one", 9, bytearray(TEXTS["one"].encode())), ("r", "unused", 9, bytearray(TEXTS["one"].encode()))]
    blobs = blobs.unionByName(spark.createDataFrame(more, schemas.BLOBS))
    n = len(folders_made(spark))
    got = scan_repo_history(refs, commits, tree_files.repartition("repo"), blobs.repartition("repo"), options=options)
    assert not any({"hits", "blob"} & set(spark.read.parquet(f).columns) for f in folders_made(spark)[n:])
    assert "collect_list(_given" not in got.stats._jdf.queryExecution().optimizedPlan().toString()
    plain = scan_repo_history(refs, commits, tree_files, blobs, options=options)
    assert sorted(got.findings.collect(), key=str) == sorted(plain.findings.collect(), key=str)
    stats = {r.repo: tuple(r)[1:] for r in got.stats.collect()}
    assert stats == {r.repo: tuple(r)[1:] for r in plain.stats.collect()}
    if options == ScanOptions():
        by_entry = scan_entries(history.repository_entries(refs, commits, tree_files, blobs))
        assert sorted(got.findings.collect(), key=str) == sorted(by_entry.select(got.findings.columns).collect(), key=str)
        assert stats == {"r": (5, 4, got.findings.count()), "q": (0, 1, 0)}


def test_handed(spark):
    rows = spark.createDataFrame([(1, "a", 7), (1, "a", 8), (1, None, 9), (2, "b", 10)], "k int, j string, v int")
    given = spark.createDataFrame([(1, "a", "x"), (1, "a", None), (1, None, "y"), (3, "b", "z")], "k int, j string, w string")
    for left in (rows, rows.repartition("k")):
        met = handed(left, given.repartition("k"), ["k", "j"], "found")
        assert met.columns == ["k", "j", "v", "found"]
        got = sorted((r.v, sorted((f.w for f in r.found), key=str)) for r in met.collect())
        assert got == [(7, [None, "x"]), (8, [None, "x"]), (9, []), (10, [])]
    # dealt as they were asked to be, and not once more
    assert dealt_by(handed(rows.repartition("k"), given.repartition("k"), ["k", "j"], "found")) == [["k"], ["k"]]
