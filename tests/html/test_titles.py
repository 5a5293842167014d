"""page_titles has a row for each page, also where a reference was cut off."""

import html
import re

import pyarrow as pa
import pyarrow.parquet as pq

from tagweave.plans.queries import QUERIES

LARGE = "/root/testdata/sf0.1/pages.parquet"


def brute(page):
    if page is None:
        return ""
    found = re.search(r"<title>(.*?)</title>", page, re.S)
    return re.sub(r"\s+", " ", html.unescape(found[1])).strip() if found else ""


def test_all_pages_have_a_title(spark, tmp_path):
    given = pq.read_table(LARGE, columns=["page_id", "html"])
    pages = [(i, p) for i, p in zip(given["page_id"].to_pylist(), given["html"].to_pylist()) if re.search("&[a-z]*<", p)]
    assert len(pages) == 13
    made = [None, "<p>no title", *(f"<title>{t}</title><p>{b}" for t, b in [("A &am", "x"), ("A &amp", "x"), ("A &quot", "x"), ("A & B &", "x"), ("A", "cut &am<b>y</b>"), ("A &amp; B", "&<i>x</i>"), ("A &lt", "&nbs")])]
    pages += [(-1 - i, p) for i, p in enumerate(made)]
    pq.write_table(pa.table({"page_id": [i for i, _ in pages], "html": pa.array([p for _, p in pages], pa.string())}), tmp_path / "pages.parquet")
    got = {r.page_id: r.title for r in QUERIES["page_titles"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(p) for i, p in pages}
