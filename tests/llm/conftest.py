import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session", autouse=True)
def llm_settings(spark):
    """Small shuffles; the tests' tables are tiny."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


class Sets:
    """Disjoint sets named by their least member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
