"""Repeated passages against marking every stretch in plain Python; WARC records against their definitions."""

from collections import defaultdict

import pytest

from attesta.llm import suffix_dedup, warc
from attesta.llm.common import documents


def plain_spans(rows, least=50):
    holders = defaultdict(set)
    texts = [(d, (t or "").encode().lower().split()) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - least + 1):
            holders[tuple(w[i:i + least])].add(d)
    out = []
    for d, w in texts:
        marked = [i for i in range(len(w) - least + 1) if len(holders[tuple(w[i:i + least])]) > 1]
        spans = []
        for i in marked:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + least
            else:
                spans.append([i, i + least, 0])
            spans[-1][2] += min(holders[tuple(w[i:i + least])]) == d
        out += [(d, *s) for s in spans]
    return sorted(out)


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_passages(spark, docs, empty, which):
    table = docs.where("doc_id is not null") if which == "fixture" else documents(spark, "/root/testdata/sf0.01")
    rows = {(r.doc_id, r.text) for r in table.collect()}
    got = sorted(tuple(r) for r in suffix_dedup.repeated_spans(table.distinct() if which == "fixture" else table).collect())
    assert got == plain_spans(rows) and got
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_passages_without_ids(docs):
    """A row without an id that repeats another document's passage has a passage of its own."""
    found = suffix_dedup.repeated_spans(docs).collect()
    assert any(r.doc_id is None for r in found) and any(r.doc_id == -5 for r in found)


def test_warc(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None, "x"), (-2, "http://a/b", "", "x"), (None, "u", "<p>a", "x"),
                                 (-3, "http://a/b", "<title>T &amp; t</title><p>one <b>two</b><br>3 &lt;"
                                  "<script>no</script><a href='/c'>link</a>", "x")],
                                "page_id long, url string, html string, record_type string")
    given = pages.select("page_id", "url", "html").unionByName(odd.drop("record_type"))
    sources = {r.record_id: r for r in warc.responses(given).collect()}
    rows = warc.derivatives(warc.responses(given)).collect()
    assert len(rows) == 2 * given.count() and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        source, headers = sources[r.refers_to], {h.name: h.value for h in r.headers}
        of = {h.name: h.value for h in source.headers}
        assert headers["WARC-Date"] == of["WARC-Date"] and headers.get("WARC-Target-URI") == of.get("WARC-Target-URI")
        assert r.block_digest == warc.digest(bytes(r.block)) and int(headers["Content-Length"]) == len(r.block)
        if r.record_type == "conversion":
            assert headers["WARC-Source-Payload-Digest"] == source.payload_digest
            assert "<p" not in bytes(r.block).decode()
        else:
            assert f"source-payload-digest: {source.payload_digest}".encode() in bytes(r.block)
            assert b"http-status: HTTP/1.1 200 OK" in bytes(r.block)
    of_3 = {r.record_type: bytes(r.block).decode() for r in rows if r.page_id == -3}
    assert of_3["conversion"] == "one two\n3 <link"
    assert "title: T & t\r\n" in of_3["metadata"] and "outlink: http://a/c\r\n" in of_3["metadata"]
    derived = warc.derivatives(warc.responses(given))
    assert sorted(map(repr, warc.page_derivatives(given).collect())) == sorted(map(repr, rows))
    index = warc.write_files(derived, f"file://{tmp_path}/warc").collect()
    assert {i.record_id for i in index} == {r.record_id for r in rows}
    back = warc.read_files(spark, f"file://{tmp_path}/warc").collect()
    key = lambda r: {h.name: h.value for h in r.headers}["WARC-Record-ID"]
    assert {key(r): (r.headers, bytes(r.block)) for r in back} == {r.record_id: (r.headers, bytes(r.block)) for r in rows}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(none)).count() == 0


@pytest.mark.parametrize("html, text, title", [
    ("<head><title>x</title><p>one<p>two", "one\ntwo", "x"),
    ("<html><head><meta a><title>x</title>one <b>two</b>", "one two", "x"),
    ("<head><title>x</title><script>no</script><style>no</style><link a><div>one</div></html>", "one", "x"),
    ("<head><title>x</title></head>one", "one", "x"),
    ("<head><title>x<p>one<p>two", "one\ntwo", "x"),
    ("<title>x</head><body>one <svg><title>y</title></svg>two", "one two", "xy"),
    ("<head><title>x</title><noscript><p>one", "one", "x"),
    ("<head><title>x</title><noscript><img a>no</noscript></head><body>one", "one", "x"),
    ("<body>one <template>two", "one two", ""),
    ("<body>one <noscript>two <noscript>no</noscript> three", "one two three", ""),
    ("<title>a <i>b</i> c</title><p>one", "one", "a b c")])
def test_omitted_and_unclosed_tags(html, text, title):
    assert warc.plain_text(html)[:2] == (text, title)
