import pytest
from pyspark.sql import functions as F

from credsift.functions.urls import split_valid, validate_repo_url
from credsift.sources.requests import load_requests, read_requests

HOST = "github.com"


def url(path, scheme="https", host=HOST):
    return f"{scheme}://{host}{path}"


# One group per rule of the check: a path of two names made of letters, digits, ``_``, ``.`` and ``-``.
ACCEPTED = {
    url("/ada/engine"): None, url("/ada/engine.git"): None, url("/ada/engine/"): None, url("/a.b/c_d-9"): None, url("/9/_"): None,
    url("/ada/engine", "HttpS"): url("/ada/engine"), url("/ada%2Dx/eng%69ne"): url("/ada-x/engine"),
    url("/ada/engine?"): url("/ada/engine"), url("/ada/engine#"): url("/ada/engine"),
}
REJECTED = {
    # length and characters come first
    url("/" + "n" * 120 + "/" + "m" * 130): "too long", url("/adä/engine"): "invalid characters", url("/ada/eng\x00ine"): "invalid characters",
    # scheme
    url("/ada/engine", "ftp"): "HTTPS", url("/ada/engine", "git"): "HTTPS", "mailto:ada@mail.net": "HTTPS", "ada/engine": "HTTPS",
    f"//{HOST}/ada/engine": "HTTPS",
    # host, exactly and in lower case
    url("/ada/engine", host="www." + HOST): "github.com", url("/ada/engine", host="notgithub.com"): "github.com",
    url("/ada/engine", host=HOST.upper()): "github.com", url("/ada/engine", host=HOST + ":8443"): "github.com",
    url("/ada/engine", host="[2001:db8::7]"): "github.com", "https:ada/engine": "github.com",
    # user information
    url("/ada/engine", host="ada@" + HOST): "credentials", url("/ada/engine", host=":@" + HOST): "credentials",
    # query and fragment
    url("/ada/engine?tab=readme"): "query parameters or fragments", url("/ada/engine#top"): "query parameters or fragments",
    # two dots in a row, also when encoded
    url("/ada/../engine"): "invalid path", url("/ada/en..gine"): "invalid path", url("/ada/%2E%2E"): "invalid path",
    # shape
    url("/ada"): "invalid GitHub URL", url("/ada/"): "invalid GitHub URL", url("/ada//engine"): "invalid GitHub URL",
    url("/ada/engine/tree/main"): "invalid GitHub URL", url("/ada/eng+ine"): "invalid GitHub URL", url("/ada/eng ine"): "invalid GitHub URL",
    url("/ada/%fe"): "invalid GitHub URL",
    # what is no URL at all
    url("/ada/engine%4"): "invalid URL format", url("/ada/engine#%q1"): "invalid URL format", ":ada": "invalid URL format",
    "7z:ada/engine": "invalid URL format", url("/ada\x1f/engine"): "invalid URL format", url("/ada/engine", host=HOST + ":https"): "invalid URL format",
    url("/ada", host="git hub.com"): "invalid URL format", url("/ada/engine", host="a da@" + HOST): "invalid URL format",
    url("/ada/engine", host="[2001:db8"): "invalid URL format", url("/ada/engine\r"): "invalid URL format",
    url("/ada/engine", host="gith%75b.com"): "invalid URL format", url("/ada/engine", host="%q@" + HOST): "invalid URL format",
}


@pytest.fixture(scope="module")
def verdicts(spark):
    df = spark.createDataFrame([(u,) for u in (*ACCEPTED, *REJECTED)], "url string")
    rows = df.select("url", validate_repo_url(F.col("url")).alias("v")).select("url", "v.*").collect()
    return {r.url: (r.clean, r.error) for r in rows}


@pytest.mark.parametrize("given", ACCEPTED)
def test_accepted(verdicts, given):
    assert verdicts[given] == (ACCEPTED[given] or given, None)


@pytest.mark.parametrize("given", REJECTED)
def test_rejected(verdicts, given):
    clean, error = verdicts[given]
    assert clean is None and REJECTED[given] in error


def test_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"request_id": 1, "repo_url": " https://github.com/a/b "}\n{"request_id": 2}\n'
        '{"request_id": 3, "repo_url": ""}\n{"request_id": 4, "repo_url": "  "}\nnot json\n'
    )
    accepted, missing = read_requests(load_requests(spark, str(tmp_path)))
    assert {r.error for r in missing.collect()} == {"request body must contain repo_url"} and missing.count() == 3
    ok, rejected = split_valid(accepted)
    assert [(r.request_id, r.clean_url) for r in ok.collect()] == [(1, "https://github.com/a/b")]
    assert [(r.request_id, r.error) for r in rejected.collect()] == [(4, "only HTTPS URLs are allowed")]
