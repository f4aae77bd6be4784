import pytest
from pyspark.sql import functions as F

from credsift.functions import filters, matching, text
from credsift.functions.errors import classify_scan_error


def column(spark, values, fn, kind="string"):
    """``fn`` over the values, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


# at the boundaries: empty, up to 8, 9, 28 and 29 characters, and beyond, with characters of several bytes
MASKS = {
    "": "", "q": "*", "qwertyui": "*" * 8, "qwertyuio": "qwer*yuio", "0123456789" * 2 + "abcdefgh": "0123" + "*" * 20 + "efgh",
    "0123456789" * 2 + "abcdefghi": "0123" + "*" * 20 + "fghi", "z9" * 60: "z9z9" + "*" * 20 + "z9z9",
    "ßüñçéèêàâ": "ßüñç*èêàâ", "🤗🤗🤗🤗🤗🤗🤗🤗": "*" * 8,
}


def test_mask_secret(spark):
    assert column(spark, list(MASKS), text.mask_secret) == list(MASKS.values())
    # the text form used inside the matching expressions is the same function
    assert column(spark, list(MASKS), lambda v: matching._apply(v, "v", matching._mask("v"))) == list(MASKS.values())


def test_truncate_text(spark):
    cases = ["a" * 120, "a" * 121, "é" * 121, ""]
    assert column(spark, cases, text.truncate_text) == ["a" * 120, "a" * 120 + "...", "é" * 120 + "...", ""]


def test_trim_all(spark):
    assert column(spark, [" a b\n", " x　", "\t"], text.trim_all) == ["a b", "x", ""]


def test_display_url(spark):
    cases = {"u/r": "u/r", "u/r.git": "u/r", "u/r/": "u/r", "u/r.git/": "u/r.git", "u/r.git.git": "u/r.git"}
    assert column(spark, list(cases), text.display_url) == list(cases.values())


def test_path_parts(spark):
    paths = ["a/b.TXT", ".png", "a.b/c", "x/y.tar.gz", "n."]
    assert column(spark, paths, text.base_name) == ["b.TXT", ".png", "c", "y.tar.gz", "n."]
    assert column(spark, paths, text.file_ext) == [".txt", ".png", "", ".gz", "."]


def test_skipped_paths(spark):
    paths = ["yarn.lock", "a/go.sum", "Yarn.lock", "a.PNG", ".png", "a.png/b", "x.tar.gz", "x.py"]
    assert column(spark, paths, filters.skip_path) == [True, True, False, True, True, False, True, False]


def test_contents(spark):
    cases = [b"", b"\x00", b"a" * 511 + b"\x00", b"a" * 512 + b"\x00", b"a" * (1 << 20), b"a" * ((1 << 20) + 1)]
    cases = [bytearray(c) for c in cases]
    assert column(spark, cases, lambda c: filters.is_binary(c, 512), "binary") == [False, True, True, False, False, False]
    assert column(spark, cases, filters.is_binary, "binary") == [False, True, True, True, False, False]
    assert column(spark, cases, lambda c: filters.within_size(c, 1 << 20), "binary") == [True, True, True, True, True, False]


def test_line_length_counts_bytes(spark):
    cases = ["a" * 4096, "a" * 4097, "é" * 2048, "é" * 2049]
    assert column(spark, cases, lambda line: filters.within_line_length(line, 4096)) == [True, False, True, False]


def test_placeholders(spark):
    dummies = ["xxx", "XXXXX", "your_password", "YOUR-KEY", "yoursecret", "changeme", "Change_Me", "<x>", "***",
               "N/A", "null", "0000", "TODO", "test"]
    real = ["xx", "xxxa", "your key", "<>", "**", "000", "tests", "my placeholder", "placeholder\n"]
    assert all(column(spark, dummies, filters.is_placeholder))
    assert not any(column(spark, real, filters.is_placeholder))


@pytest.mark.parametrize("mode,url_dropped", [("as_documented", False), ("as_coded", True)])
def test_false_positive_lines(spark, mode, url_dropped):
    dropped = ["x = regexp.MustCompile(`a`)", "re.compile(", "PATTERN  = 1", "a // b", "//x", "# Example", "#sample",
               "latest api_key", "FAKE_KEY", "mail@example.com", "http:localhost"]
    kept = ["token = 1", "# note", "key test", "example.org"]
    check = lambda lines: column(spark, lines, lambda v: filters.false_positive_line(v, mode))
    assert all(check(dropped))
    assert not any(check(kept))
    assert check(["https://h/x"]) == [url_dropped]


def test_severity_rank_and_id(spark):
    assert column(spark, ["medium", "critical", "high"], text.severity_rank) == [2, 0, 1]
    ids = column(spark, ["a", "b", "a"], lambda v: text.finding_id(F.lit("r"), v, F.lit(None).cast("string"), F.lit(1)))
    assert ids[0] == ids[2] != ids[1] and len(ids[0]) == 64


def test_split_text(spark):
    cases = [bytearray(b"a\r\n\nb\n"), bytearray(b""), bytearray(b"\xff\nok\n\xc3")]
    lines = column(spark, cases, lambda v: F.transform(matching.split_text(v.cast("string")), lambda x: F.hex(x)), "binary")
    assert lines == [["610D", "", "62", ""], [""], ["FF", "6F6B", "C3"]]


def test_classify_scan_error(spark):
    cases = {
        "cloning: Repository Not Found": 404, "context timeout": 408, "TIMEOUT": 500, "hash 9404ab": 404,
        "Authentication Required": 404, "no such host": 404, "disk cap": 500, "timeout 404": 408,
    }
    out = column(spark, list(cases), classify_scan_error)
    assert [o.status for o in out] == list(cases.values())
    assert out[0].error == "repository not found or private"
    late = column(spark, ["disk cap"], lambda v: classify_scan_error(v, F.lit(True)))
    assert late[0].status == 408 and late[0].error == "scan timeout"
