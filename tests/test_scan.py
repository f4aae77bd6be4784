"""Scan semantics on small files: repeats, caps, order, context, line and file filters."""

import random
import time
from dataclasses import asdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credsift.functions import matching
from credsift.operators import findings
from credsift.operators.entries import cap_entries, scannable, split_lines
from credsift.operators.findings import cap_total, dedupe_and_cap, new_findings, triage_order, triage_summary
from credsift.options import SERVICE_LIMITS, ScanOptions
from credsift.plans.scan import entry_hits, scan_entries
from credsift.rules import DEFAULT_RULES, Rule, select_rules
from workloads import queries

SERVICE = asdict(SERVICE_LIMITS)


def key_id(seed):
    """A made-up key id: the rule's prefix and 16 characters from a seed."""
    return "AKIA" + "".join(random.Random(seed).choices("BCDEFGHJKLMNPQRSTUVW23456789", k=16))


def masked(value):
    return value[:4] + "*" * min(20, len(value) - 8) + value[-4:]


KEY_ID = key_id(1)
KEY_LINE = f"cloud.id={KEY_ID}"


def scan(df, **options):
    rows = scan_entries(df, options=ScanOptions(**options)).collect()
    return sorted(rows, key=lambda r: (r.repo, r.entry_seq, r.line, r.rule_ord, r.match_ord))


def found(df, **options):
    return [(r.file, r.line, r.type, r.matched_value) for r in scan(df, **options)]


def test_one_key(entries):
    assert found(entries(("conf/cloud.ini", KEY_LINE))) == [("conf/cloud.ini", 1, "aws_access_key_id", masked(KEY_ID))]


def test_capture_group_is_the_value(entries):
    value = "".join(random.Random(2).choices("bcdfghjkmnpqrstvwxz+/23456789", k=40))
    [hit] = found(entries(("vars.sh", f'export AWS_SECRET_KEY="{value}"')))
    assert hit[2:] == ("aws_secret_access_key", masked(value))


def test_repeats(entries):
    assert len(found(entries(("n1", f"{KEY_LINE}\nagain {KEY_ID}\n{KEY_ID}")))) == 1
    assert len(found(entries(*[(f"n{i}", KEY_LINE) for i in range(3)]))) == 3
    # the same path in a later entry, and the same path in another repository
    assert [r.entry_seq for r in scan(entries(("n", KEY_LINE), ("n", f"\n{KEY_LINE}")))] == [0]
    assert len(found(entries(("r1", 0, "n", KEY_LINE), ("r2", 0, "n", KEY_LINE)))) == 2


def test_filtered(entries):
    assert found(entries(("n", "aws_secret=" + "*" * 40))) == []
    assert found(entries(("scan.py", f'KEY = re.compile("{KEY_ID}")'))) == []
    assert found(entries(("photo.jpeg", KEY_ID), ("sub/poetry.lock", KEY_ID), ("n.txt", f"{KEY_ID}\x00"))) == []


def test_nothing_is_too_long_unless_a_limit_says_so(entries):
    long_line = entries(("min.css", "a{} " * 1500 + KEY_ID))
    assert len(found(long_line)) == 1 and found(long_line, **SERVICE) == []
    large = entries(("dump.sql", KEY_LINE + "\n" * (1 << 20)))
    assert len(found(large)) == 1 and found(large, **SERVICE) == []
    late_nul = entries(("n", KEY_LINE + "\n" * 600 + "\x00"))
    assert found(late_nul) == [] and len(found(late_nul, **SERVICE)) == 1
    fits = entries(("dump.sql", KEY_LINE + "\n" * ((1 << 20) - len(KEY_LINE))))
    assert len(found(fits, **SERVICE)) == 1


def test_overlapping_values_leave_nothing_in_clear(entries):
    password, other = "passw" + str(10**3 + 99), "longer" + "word"
    line = f"mongodb://user:{password}@one.internal.net,postgres://user:{other}@two.internal.net/db1"
    contexts = {r.context for r in scan(entries(("n", line)))}
    assert contexts and all(password not in c and other not in c for c in contexts)


def test_many_short_values_on_one_line(entries):
    line = " ".join(f"x{i} {key_id(i)}" for i in range(12))
    rows = scan(entries(("n", line)))
    assert len(rows) == 12 and rows[0].context == " ".join(f"x{i} {masked(key_id(i))}" for i in range(12))


def test_user_rules(entries):
    def values(rule, text):
        return [r.matched_value for r in scan_entries(entries(("n", text)), (rule,)).collect()]

    assert values(Rule("r", "high", r"TokenX=([a-z0-9]{12})", anchors=("TokenX",)), "a TokenX=abcdef123456") == [masked("abcdef123456")]
    optional = Rule("r", "high", r"(abc)?def[0-9]{4}")
    assert values(optional, "def1234") == ["*" * 7] and values(optional, "abcdef1234") == ["***"]


def test_line_numbers_start_at_one(entries):
    assert found(entries(("n", "\n" * 6 + KEY_LINE)))[0][1] == 7


def test_entry_cap(entries):
    body = entries(("all.txt", "\n".join(map(key_id, range(90)))))
    assert [line for _, line, _, _ in found(body, max_findings_per_entry=35)] == list(range(1, 36))
    assert len(found(body)) == 90


def test_a_key_cut_by_the_cap_may_come_later(entries):
    body = "\n".join(map(key_id, range(45)))
    thrice = entries(("n", body), ("n", body), ("n", body))
    want = [(0, i) for i in range(1, 36)] + [(1, i) for i in range(36, 46)]
    assert [(r.entry_seq, r.line) for r in scan(thrice, max_findings_per_entry=35)] == want
    assert len(scan(thrice, max_findings_per_entry=35, exact_cap=False)) == 35


def test_total_cap_keeps_the_last_entry_whole(entries):
    body = "\n".join(map(key_id, range(10)))
    files = entries(*[("r", i, f"f{i}", body) for i in range(8)], *[("s", i, f"f{i}", body) for i in range(2)])
    kept = scan(files, max_findings=25)
    assert {(r.repo, r.entry_seq) for r in kept} == {("r", 0), ("r", 1), ("r", 2), ("s", 0), ("s", 1)}
    assert len(kept) == 50


def brute_force(hits, per_entry, total):
    """The sequential scan, row by row, over hits of one repository in order."""
    seen, out, done = set(), [], False
    by_entry = {}
    for h in sorted(hits, key=lambda h: (h.entry_seq, h.line_idx, h.rule_ord, h.match_ord)):
        by_entry.setdefault(h.entry_seq, []).append(h)
    for entry_hits_ in by_entry.values():
        if done:
            break
        taken = 0
        for h in entry_hits_:
            key = (h.rule_id, h.masked, h.path)
            if taken < per_entry and key not in seen:
                seen.add(key)
                taken += 1
                out.append((h.entry_seq, h.line_idx, h.rule_ord, h.match_ord))
        done = len(out) >= total
    return out


@pytest.mark.parametrize("seed", range(4))
def test_caps_against_the_sequential_scan(entries, seed):
    rng = random.Random(seed)
    files = [
        (rng.choice("ab"), "\n".join(key_id(rng.randrange(30)) for _ in range(rng.randrange(25))))
        for _ in range(20)
    ]
    df = entries(*files)
    hits = entry_hits(df, options=ScanOptions()).collect()
    for per_entry, total in ((5, 40), (3, 17), (8, 1000)):
        got = scan(df, max_findings_per_entry=per_entry, max_findings=total)
        assert [(r.entry_seq, r.line - 1, r.rule_ord, r.match_ord) for r in got] == brute_force(hits, per_entry, total)


def test_a_hot_repository_is_cut_in_salted_parts(spark, entries):
    files = entries(*[("r", i, f"f{i}", KEY_LINE) for i in range(300)])
    hits = dedupe_and_cap(entry_hits(files))
    for salts in (1, 7, 64):
        assert sorted(r.entry_seq for r in cap_total(hits, 20, salts).collect()) == list(range(20))
        assert sorted(r.entry_seq for r in cap_entries(files, 20, salts).collect()) == list(range(20))
        keys = files.select("repo", "entry_seq", "path")
        assert sorted(r.entry_seq for r in cap_entries(keys, 20, salts).collect()) == list(range(20))
    assert cap_entries(files, 300).count() == 300 == cap_entries(files, 1000).count()


def test_context(entries):
    text = f"password = 'blue-kettle'  # example\n{KEY_LINE}\nlast"
    redacted = f"password = '{masked('blue-kettle')}'  # example\ncloud.id={masked(KEY_ID)}\nlast"
    assert [r.context for r in scan(entries(("n", text)))] == [redacted]
    assert [r.context for r in scan(entries(("n", text)), context="raw")] == [text]
    assert [r.context for r in scan(entries(("n", text)), context="none")] == [None]
    body = f"{'b' * 5000}\n{KEY_LINE}"
    assert [r.context for r in scan(entries(("n", body)), **SERVICE)] == [f"cloud.id={masked(KEY_ID)}"]
    assert [r.context for r in scan(entries(("n", body)))] == [f"{'b' * 5000}\ncloud.id={masked(KEY_ID)}"]
    assert [r.context for r in scan(entries(("n", body)), **{**SERVICE, "context": "raw"})] == [body]


def test_invalid_utf8(entries):
    body = b"\xff\xfe bad\n" + KEY_LINE.encode() + b"\nok \xc3\n" + b"\xc3" * 4096 + KEY_LINE.encode() + b"\n"
    [hit] = scan(entries(("a", body)), **{**SERVICE, "context": "raw"})
    assert (hit.line, hit.context) == (2, KEY_LINE)
    # bytes are counted, not replacement characters: this line is just short enough
    short = b"\xff" * (4096 - len(KEY_LINE)) + KEY_LINE.encode()
    assert len(scan(entries(("a", short)), **SERVICE)) == 1


def test_report_columns_and_ids(spark, entries):
    df = entries(("a.txt", KEY_LINE)).withColumn("commit_message", F.lit("m" * 130))
    first, again = (scan_entries(df).collect()[0] for _ in range(2))
    assert first == again and len(first.id) == 64
    assert first.commit_message == "m" * 120 + "..."
    assert (first.severity, first.description) == ("critical", "AWS Access Key ID detected")
    other = scan_entries(entries(("b.txt", KEY_LINE)))
    both = scan_entries(df).unionByName(other)
    assert [r.file for r in new_findings(both, scan_entries(df)).collect()] == ["b.txt"]


def test_two_rules_on_one_value(entries):
    line = 'azure_client_secret = "' + "a1" * 17 + '"'
    assert [t for _, _, t, _ in found(entries(("a", line)))] == ["azure_client_secret", "hardcoded_password"]
    only = select_rules(DEFAULT_RULES, "hardcoded_password")
    assert scan_entries(entries(("a", line)), only).count() == 1


def test_triage(entries):
    files = entries(("a", "SECRET=0123456789ab"), ("b", KEY_LINE), ("c", "password = 'abcdefgh'"))
    findings = scan_entries(files)
    assert [r.severity for r in triage_order(findings).collect()] == ["critical", "high", "medium"]
    totals = {(r.severity, r.type): (r.findings, r.files) for r in triage_summary(findings).collect()}
    assert totals[(None, None)] == (3, 3) and totals[("critical", "aws_access_key_id")] == (1, 1)


def test_lines_and_scannable(entries):
    df = entries(("a", "x\r\n\ny\n"), ("b.png", "x"))
    assert [(r.line_no, r.line) for r in split_lines(scannable(df)).orderBy("line_no").collect()] == [
        (1, "x\r"), (2, ""), (3, "y"), (4, "")
    ]


def test_plan_shuffles_hits_only(entries):
    """Content is read and matched in the scan stage; no exchange carries it."""
    df = scan_entries(entries(("a", KEY_LINE)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    below_first_exchange = plan.rsplit("Exchange", 1)[1]
    assert "content#" in below_first_exchange
    assert all("content" not in line for line in plan.splitlines() if "Exchange" in line)


def test_options_are_checked():
    with pytest.raises(ValueError):
        ScanOptions(context="masked")


def test_many_secrets_on_one_line(spark, entries):
    """Each line is masked once: work is not a power of the secrets in it."""
    rng = random.Random(8)
    values = ["".join(rng.choices("bcdfghjkmnpqrstvwxz", k=12)) for _ in range(5_000)]
    line = " ".join(f'password="{v}"' for v in values)
    started = time.monotonic()
    rows = scan_entries(entries(("a.env", f"first\n{line}\nlast"))).select("matched_value", "context").collect()
    assert time.monotonic() - started < 60
    assert sorted(r.matched_value for r in rows) == sorted({masked(v) for v in values})
    assert {r.context for r in rows} == {"first\n" + " ".join(f'password="{masked(v)}"' for v in values) + "\nlast"}


@pytest.mark.parametrize("size", [1, 3, 256])
def test_masking_in_pieces(spark, monkeypatch, size):
    """Places that overlap, touch, repeat and cross pieces are masked like in a plain walk over the line."""
    monkeypatch.setattr(matching, "PIECE", size)
    rng = random.Random(size)
    rows = []
    for i in range(60):
        line = "".join(rng.choices(["ab", "abc", "é", "🙂", "x", " ", "\\E", "aba"], k=rng.randrange(1, 30)))
        cuts = [sorted(rng.sample(range(len(line) + 1), 2)) for _ in range(rng.randrange(4))]
        rows.append((i, line, [(line[a:b],) for a, b in cuts]))
    df = spark.createDataFrame(rows, "i int, line string, found array<struct<raw: string>>")
    body = matching._masked_line("l.line", "l.found")
    got = {r.i: r.t for r in df.select("i", F.expr(f"transform(array(struct(line, found)), l -> {body})[0] AS t")).collect()}
    for i, line, found_ in rows:
        assert got[i] == hidden(line, {raw for raw, in found_})


def hidden(line, values):
    spans = []
    for v in values:
        at = line.find(v)
        while at >= 0:
            spans.append((at, at + len(v)))
            at = line.find(v, at + len(v))
    islands = []
    for s, e in sorted(spans):
        if islands and s < islands[-1][1]:
            islands[-1][1] = max(e, islands[-1][1])
        else:
            islands.append([s, e])
    out, at = "", 0
    for s, e in islands:
        value = line[s:e]
        out += line[at:s] + ("*" * len(value) if len(value) <= 8 else masked(value))
        at = e
    return out + line[at:]


def test_line_filter_looks_at_hit_lines_only(spark, monkeypatch):
    """A line without secrets has a NULL where others have a list; the filter is not tried on it."""
    monkeypatch.setattr(
        matching, "_looks_like_code", lambda line, _: f"if(contains({line}, 'AKIA'), false, cast(raise_error('looked at') AS boolean))"
    )
    text = "clean\nAWS_KEY=AKIA" + "Q" * 16 + "\nalso clean"
    hits = spark.createDataFrame([(text,)], "t string").select(matching.content_hits(F.col("t")).alias("h")).first().h
    assert [h.line_idx for h in hits] == [1]


def test_single_values_are_replaced(spark):
    """Replacing the places of one value gives what joining and masking all places gives."""
    rows = [
        ("key=abcabcabcX", ["abc"]), ("aaaaa", ["aa"]), ("aaaaaa", ["aa", "aa"]), ("a.c(b)$ a.c(b)$", ["a.c(b)$"]),
        (r"x\E y\Qz x\E", [r"x\E"]), ("ключ🔑🔑 ключ🔑🔑", ["ключ🔑🔑"]), ("0123456789abcdef" * 40, ["789abcdef0"]),
        ("abcdef", ["bcd", "cde"]), ("abc abd", ["abc", "abd"]), ("nothing", []),
    ]
    df = spark.createDataFrame([(line, [(v,) for v in values]) for line, values in rows], "line string, found array<struct<raw: string>>")
    short, long = (F.expr(f("line", "found")) for f in (matching._masked_line, matching._masked_places))
    got = df.select("line", short.alias("short"), long.alias("long")).collect()
    assert [r.short for r in got] == [r.long for r in got] and [r.line for r in got if r.short == r.line] == ["nothing"]
    # bytes that are no text go the long way
    raw = df.limit(1).select(F.expr("cast(X'6162FF6162' AS string)").alias("line"), F.expr("array(struct('ab' AS raw))").alias("found"))
    pair = raw.select(short.cast("binary").alias("short"), long.cast("binary").alias("long")).first()
    assert pair.short == pair.long


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_over_many_batches(seed):
    """Reported keys are passed over by the batch; what is kept is that of a plain walk over the rows."""
    rng = random.Random(seed)
    rows = sorted(
        ((rng.choice("rs"), rng.choice("pq"), rng.randrange(40), rng.choice("abc"), rng.choice(["x", "y", "z", None]), i) for i in range(900)),
        key=lambda r: (*r[:3], r[5]),
    )
    names = ["repo", "path", "entry_seq", "rule_id", "masked", "i"]
    kinds = pa.schema([*((n, pa.int64() if n in ("entry_seq", "i") else pa.string()) for n in names)])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows[a:a + 17]), kinds)], schema=kinds) for a in range(0, len(rows), 17)]
    got = [i for b in findings._reported_in_turn(2)(iter(batches)) for i in b.column("i").to_pylist()]
    want, reported, taken = [], set(), {}
    for repo, path, entry, rule, masked_, i in rows:
        if taken.get((repo, path, entry), 0) < 2 and (repo, path, rule, masked_) not in reported:
            reported.add((repo, path, rule, masked_))
            taken[repo, path, entry] = taken.get((repo, path, entry), 0) + 1
            want.append(i)
    assert got == want and len(got) < 200


def test_carry_over_folds_what_it_returns(spark):
    """Rows that go through the fold carry no context nor columns of commits."""
    plan = queries.dedupe_and_cap_carry_over(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    fold = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "masked" in fold and "context" not in fold and "commit" not in fold
