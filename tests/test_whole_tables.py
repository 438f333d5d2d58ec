"""Queries that SQL can't express, over whole tables, against brute force."""

import html
import re

from pagegrain.queries import QUERIES

#: References of every kind whose meaning html.unescape and the HTML standard share.
TEXTS = ["plain", "a & b", "&amp;lt; &lt;&quot;", "caf&eacute; &hellip; &NotEqualTilde;", "&copy 2020 &ampx", "&#65;&#x42; &#128; &#0; &#xD800;", "&nope; &; &#; &", "&Aacute", "", None]


def tables(spark, path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    rows = [(i, f"http://h.x/{i}", None if t is None else f"<!DOCTYPE html><title>T</title><p>{t}</p>") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")


def test_references_of_whole_tables(spark, tmp_path):
    tables(spark, tmp_path)
    plain = {i: None if t is None else html.unescape(t) for i, t in enumerate(TEXTS)}
    page = {i: None if t is None else re.sub(r"\s+", " ", f"T{t}").strip() for i, t in plain.items()}
    for name, want in (("entity_decoding", plain), ("fragment_text", plain), ("page_text", page)):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == len(TEXTS)
        assert {r.doc_id: r.text for r in got} == want, name
