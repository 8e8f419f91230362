"""Fill-in-the-middle: the plain string version, round trips, and edges."""
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from tollgate.llm import bytesnp, fill_middle


def plain(doc_id, text):
    """The contract on Python strings."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(t), sha(t))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" if form == "psm" else f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return (doc_id, n, form, a, b - a, sha(out), sha(t))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def report(docs):
    return fill_middle.report(fill_middle.transform(docs))


def test_edges_equal_the_string_version(spark):
    extra = [(i, t, None, None, None, 0, "k", "r", 0, "x") for i, t in [
        (100 + k, "añ😀 der <P" * k + "<S" + "ж" * k) for k in range(1, 25)] + [(200, "has <M> inside"), (201, "<"), (202, "ñ"), (203, "S>" * 9)]]
    data = X.edge_rows() + extra
    assert rows(report(X.documents(spark, data))) == sorted((plain(r[0], r[1]) for r in data), key=str)


def test_corpus_equals_the_string_version(spark):
    pairs = X.corpus()
    got = rows(report(X.simple(spark, pairs)))
    assert got == sorted((plain(*p) for p in pairs), key=str)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


def test_restore_gives_the_texts_back(spark):
    docs = X.documents(spark)
    back = fill_middle.restore(fill_middle.transform(docs, rate=100, spm=50))
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in X.edge_rows())


def test_long_text_is_counted_in_runs(spark, monkeypatch):
    monkeypatch.setattr(bytesnp, "SLICE", 64)  # of the direct calls below
    text = "añ😀" * 999
    data = __import__("numpy").frombuffer(text.encode(), "uint8")
    assert fill_middle._points(data) == len(text)
    points = [0, 1, 2, 500, 1500, len(text)]
    assert fill_middle._byte_of(data, points) == [len(text[:p].encode()) for p in points]


def test_long_and_empty_tables(spark):
    long = "ñandu 😀 " * 700_000  # about 8 MB
    assert rows(report(X.simple(spark, [(5, long), (6, long[:-1])]))) == sorted([plain(5, long), plain(6, long[:-1])], key=str)
    assert report(X.documents(spark, [])).count() == 0


def test_sentinels_may_not_overlap(spark):
    for bad in (("<P>", "><S", "<M>"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "xaby", "c")):
        with pytest.raises(ValueError):
            fill_middle.transform(X.documents(spark), sentinels=bad)
    made = fill_middle.transform(X.documents(spark), sentinels=("[pre]", "[suf]", "[mid]"), rate=100)
    assert made.where(F.col("form") != "plain").where(~F.col("output").contains("[mid]")).count() == 0
