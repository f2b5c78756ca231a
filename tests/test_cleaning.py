from __future__ import annotations

from tomeseek.operators import cleaning
from tomeseek.plans import joins


def test_page_text(spark):
    pages = {
        1: '<html><head><title>A &amp;amp; <i>B</i></title><style>p{}</style><SCRIPT>x("</p>")</SCRIPT></head>'
           "<body><nav>menu</nav><!-- a <b> --><h1>Head</h1><p>one<b>two</b>&nbsp; three<br>four 1 < 2</p></body>",
        2: None, 3: "", 4: "no tags", 5: "<p>seen</p><script>never closed", 6: "<p>seen</p><!-- never closed",
    }
    rows = [(i, f"u{i}", h) for i, h in pages.items()]
    got = {r.page_id: (r.title, r.text) for r in cleaning.page_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == ("A &amp; B", "Head\nonetwo three\nfour 1 < 2")
    assert got[2] == (None, None) and got[3] == ("", "") and got[4] == ("", "no tags")
    assert got[5] == ("", "seen") and got[6] == ("", "seen")


def test_boilerplate_both_ways(make_docs, monkeypatch):
    texts = {1: "menu\nfirst\n\n menu ", 2: "second\nmenu", 3: "menu\nthird", 4: "", 5: "copied\nlines", 6: "copied\nlines", 7: "copied\nlines", 8: "menu"}
    docs = make_docs(texts)
    docs = docs.union(make_docs({9: ""}).selectExpr("doc_id", "CAST(NULL AS string) AS text", "lang", "source", "n_chars"))
    for small in (True, False):
        monkeypatch.setattr(joins, "is_small", lambda df, small=small: small)
        got = {r.doc_id: (r.text, r.n_chars, r.n_dropped) for r in cleaning.drop_boilerplate(docs).collect()}
        assert got == {
            1: ("first\n", 6, 2), 2: ("second", 6, 1), 3: ("third", 5, 1), 4: ("", 0, 0), 5: ("copied\nlines", 12, 0),
            6: ("copied\nlines", 12, 0), 7: ("copied\nlines", 12, 0), 8: ("", 0, 1), 9: (None, None, 0)}
