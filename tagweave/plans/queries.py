"""Queries over the driver's tables, and the SQL that gives the same rows.

HTML is built from relational rows, parsed and queried; the SQL answers the
same question from the rows themselves and never reads HTML. Queries over
pages are held against regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as H
from ..functions import lists as L
from ..functions import lookup as K
from ..operators.serialize import Output
from ..operators.tags import BLOCK
from ..sources.html import node_table, parse_html, prefilter, spread
from . import local, relational


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, selector: str | None = None, fields=(), cols=("page_id",)) -> DataFrame:
    """Parsed pages; with a selector, the rows without a match go before they are parsed."""
    df = table(spark, sf_dir, "pages").select(*cols, "url", "html")
    if selector:
        df = df.where(prefilter(F.col("html"), selector))
    return parse_html(spread(df), base_col="url", fields=fields, selectors=[selector] if selector and not fields else ())


def matches(df: DataFrame, selector: str, *keys: str) -> DataFrame:
    """(keys, n) for each match."""
    return df.select(*keys, F.explode(local.select(F.col("dom"), selector)).alias("n"))


def found(df: DataFrame, selector: str, *keys: str, **values: Callable[[Column], Column]) -> DataFrame:
    """The keys and some values for each match. What a match takes of its document is taken within the array: rows that carried dom along would be copies of it, one a match."""
    each = F.transform(local.select(F.col("dom"), selector), lambda n: F.struct(*[f(n).alias(name) for name, f in values.items()]))
    return df.select(*keys, F.inline(each))


# -- fixtures ------------------------------------------------------------------


def element(tag: str, content: Column, **attrs) -> Column:
    parts = [F.lit(f"<{tag}")]
    for k, v in attrs.items():
        parts += [F.lit(f' {k.strip("_").replace("_", "-")}="'), H.escape(v, True) if isinstance(v, Column) else F.lit(v), F.lit('"')]
    return F.concat(*parts, F.lit(">"), content, F.lit(f"</{tag}>"))


def listing(df: DataFrame, key: str, order: str, item: Column, before: str, after: str, few: bool = True) -> DataFrame:
    """(key, html): the items of each key in order; few: keys that may fall to a task or two, and are dealt anew; many keys are dealt as they stand, before items are longer than their rows."""
    rows = (df if few else df.repartition(key)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("h")))).alias("rows"))
    documents = rows.select(key, F.concat(F.lit(before), F.array_join(F.transform("rows", lambda r: r["h"]), ""), F.lit(after)).alias("html"))
    return spread(documents) if few else documents


def nation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    item = element("li", H.escape(F.col("n_name")), id=F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), title=F.col("n_name"), class_=F.concat(F.lit("nat k"), (F.col("n_nationkey") % 3).cast("string")), data_key=F.col("n_nationkey").cast("string"))
    return listing(n, "n_regionkey", "n_nationkey", item, "<p>top</p><ul>", "</ul>")


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    row = element("tr", F.concat(element("td", H.escape(F.col("p_name")), class_="name"), element("td", F.col("p_size").cast("string"), data_size=F.col("p_size").cast("string"))))
    return listing(p, "p_brand", "p_partkey", row, "<table>", "</table>")


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section an order: its lines as items, flags in bold in every other line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    flag = F.col("l_returnflag")
    content = F.when(F.col("l_linenumber") % 2 == 1, F.concat(element("b", flag), F.lit(" odd"))).otherwise(F.concat(F.lit("even "), flag))
    item = element("li", content, data_line=F.col("l_linenumber").cast("string"), class_=F.col("l_linestatus"))
    return listing(lines, "l_orderkey", "l_linenumber", item, "<section><ol>", "</ol></section>", few=False)


def mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    number = F.col("l_linenumber").cast("string")
    item = F.when(F.col("l_linenumber") % 2 == 1, element("em", number)).otherwise(element("span", number))
    return listing(lines, "l_orderkey", "l_linenumber", item, "<div>", "</div>", few=False)


def part_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of parts a brand."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    item = element("li", H.escape(F.col("p_name")), id=F.concat(F.lit("p"), key), title=F.col("p_name"), class_=F.concat(F.lit("part k"), (F.col("p_partkey") % 3).cast("string")), data_key=key)
    return listing(p, "p_brand", "p_partkey", item, "<p>top</p><ul>", "</ul>")


def parts(selector: str):
    """A query for what a selector finds in the lists of parts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = parse_html(part_lists(spark, sf_dir), selectors=[selector], nodes=("attr_map",))
        return matches(df, selector, "p_brand").select("p_brand", F.col("n")["attr_map"]["data-key"].alias("part"), F.col("n")["attr_map"]["title"].alias("name"))

    return run


def parts_where(which: str) -> str:
    """Parts with their places among those of a brand; which: a condition on them."""
    return f"""
WITH t AS (SELECT p_brand, p_partkey, p_name AS name, p_partkey % 3 AS k,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS j,
  lag(p_partkey % 3) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before,
  max(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had
  FROM part)
SELECT p_brand, p_partkey::VARCHAR AS part, name FROM t WHERE {which}"""


def numbered(which: str) -> str:
    """Nations with their places among those of a region; which: a condition on them."""
    return f"""
WITH t AS (SELECT n_regionkey, n_nationkey, n_name AS name,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS j,
  count(*) OVER (PARTITION BY n_regionkey) AS n,
  lag(n_nationkey % 3) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS before,
  max(CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had
  FROM nation)
SELECT n_regionkey, name FROM t WHERE {which}"""


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


SELECTORS = {
    "tag": ("li", "true"),
    "id": ("#p7", "p_partkey = 7"),
    "class": ("li.K1", "k = 1"),
    "attribute": ("li[data-key]", "true"),
    "attribute_prefix": ("li[^data-]", "true"),
    "attribute_equals": ("[title='Blue Bolt']", "name = 'blue bolt'"),
    "attribute_not_equals": ("li[title!='RED WIDGET']", "name <> 'red widget'"),
    "attribute_starts": ("li[title^=S]", "starts_with(name, 's')"),
    "attribute_ends": ("li[title$=ING]", "ends_with(name, 'ing')"),
    "attribute_contains": ("li[title*='l b']", "contains(name, 'l b')"),
    "attribute_matches": ("li[title~=^[a-h]]", "regexp_matches(name, '^[a-h]')"),
    "index_lt": ("li:lt(2)", "i - 1 < 2"),
    "index_gt": ("li:gt(2)", "i - 1 > 2"),
    "index_eq": ("li:eq(1)", "i - 1 = 1"),
    "first_child": ("li:first-child", "i = 1"),
    "last_child": ("li:last-child", "j = 1"),
    "nth_child": ("li:nth-child(2n+1)", "i % 2 = 1"),
    "nth_child_even": ("li:nth-child(even)", "i % 2 = 0"),
    "nth_last_child": ("li:nth-last-child(2)", "j = 2"),
    "nth_of_type": ("li:nth-of-type(3)", "i = 3"),
    "nth_last_of_type": ("li:nth-last-of-type(odd)", "j % 2 = 1"),
    "first_of_type": ("li:first-of-type", "i = 1"),
    "last_of_type": ("li:last-of-type", "j = 1"),
    "contains": ("li:contains(ALL R)", "contains(name, 'all r')"),
    "contains_own": ("li:containsOwn(DGET)", "contains(name, 'dget')"),
    "matches_text": ("li:matches(^[a-r ]+$)", "regexp_matches(name, '^[a-r ]+$')"),
    "matches_own": ("li:matchesOwn([dt] [b-g])", "regexp_matches(name, '[dt] [b-g]')"),
    "child": ("ul > li", "true"),
    "descendant": ("body li", "true"),
    "adjacent": (".k0 + li", "before = 0"),
    "later_sibling": (".k0 ~ li", "had = 1"),
    "not": ("li:not(.k0)", "k <> 0"),
    "or": ("#p3, .k2, #p3", "p_partkey = 3 OR k = 2"),
    "and": ("li.part.k1[title*=bolt]:not(:first-child)", "k = 1 AND contains(name, 'bolt') AND i > 1"),
    "precedence": ("#p3, ul > .k2", "p_partkey = 3 OR k = 2"),
    "leading_combinator": ("> html li.k1", "k = 1"),
    "universal_and_root": ("html:root *.k2", "k = 2"),
}
for _name, (_css, _sql) in SELECTORS.items():
    query(f"select_{_name}", parts_where(_sql))(parts(_css))


@query("select_only_child", "SELECT l_orderkey, l_linenumber::VARCHAR AS line FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n = 1")
def select_only_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(order_trees(spark, sf_dir), selectors=["li:only-child"], nodes=("attr_map",))
    return matches(df, "li:only-child", "l_orderkey").select("l_orderkey", F.col("n")["attr_map"]["data-line"].alias("line"))


@query("select_only_of_type", "SELECT l_orderkey, l_linenumber::VARCHAR AS line FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 2) AS n FROM lineitem) WHERE n = 1")
def select_only_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = "div > *:only-of-type"
    df = parse_html(mixed_types(spark, sf_dir), selectors=[css], nodes=("text",))
    return matches(df, css, "l_orderkey").select("l_orderkey", F.col("n")["text"].alias("line"))


def by_windows(selector: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = parse_html(part_lists(spark, sf_dir), selectors=[selector], nodes=(*relational.READ, "attr_map"))
        return relational.select(node_table(df, "p_brand"), selector, "p_brand").select("p_brand", F.col("attr_map")["data-key"].alias("part"), F.col("attr_map")["title"].alias("name"))

    return run


for _name in ("child", "descendant", "adjacent", "later_sibling", "not", "or", "and", "nth_child", "contains"):
    query(f"joins_{_name}", parts_where(SELECTORS[_name][1]))(by_windows(SELECTORS[_name][0]))
query("joins_has", parts_where("k = 1 AND i > 1"))(by_windows("html > body:has(ul > li + li) > ul li + .k1"))


# -- pages -------------------------------------------------------------------------


@query(
    "nav_links",
    r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text FROM pages)
SELECT page_id, replace(replace(href, '&quot;', '"'), '&amp;', '&') AS href,
  replace(replace(text, '&quot;', '"'), '&amp;', '&') AS text,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(replace(href, '&quot;', '"'), '&amp;', '&') AS abs_url
FROM a""",
)
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir, "nav a[href]", fields=("anc", "text"))
    rows = matches(df, "nav a[href]", "page_id", "base_uri")
    return rows.select("page_id", H.attr(F.col("n"), "href").alias("href"), F.col("n")["text"].alias("text"), H.abs_url(F.col("n"), F.col("base_uri"), "href").alias("abs_url"))


@query("page_language", """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages""")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir, cols=("page_id",))
    first = lambda css, key: H.first_attr(local.select(F.col("dom"), css), key)
    return df.select("page_id", first("html", "lang").alias("lang"), first("meta[charset]", "charset").alias("charset"))


@query("ads", """SELECT page_id, count(*) AS ads FROM (SELECT page_id, unnest(regexp_extract_all(html, '<div class="ad">')) FROM pages) GROUP BY page_id""")
def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir, "div.ad")
    return df.select("page_id", F.size(local.select(F.col("dom"), "div.ad")).cast("long").alias("ads")).where("ads > 0")


@query("comments", r"SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) AS comment FROM pages")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    return df.select("page_id", F.explode(F.filter("dom", lambda n: n["kind"] == "comment")).alias("n")).select("page_id", F.col("n.content").alias("comment"))


@query("script_data", r"SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS script, regexp_extract(html, '<style>(.*?)</style>', 1, 's') AS style FROM pages")
def script_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir, fields=("data",))
    data = lambda tag: H.first_by_tag(F.col("dom"), tag)["data"]
    return df.select("page_id", data("script").alias("script"), data("style").alias("style"))


@query("contains_data", r"SELECT page_id FROM pages WHERE contains(html, 'track(')")
def contains_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir, "script:containsData(track)")
    return matches(df, "script:containsData(track)", "page_id").select("page_id")


@query("element_counts", r"""SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS li, len(regexp_extract_all(html, '<a '))::BIGINT AS a, len(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 's'), '<p>'))::BIGINT AS p FROM pages""")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    count = lambda css: F.size(local.select(F.col("dom"), css)).cast("long").alias(css)
    return df.select("page_id", count("li"), count("a"), count("p"))


@query("page_nodes", r"SELECT page_id, 1::BIGINT AS roots, 1::BIGINT AS bodies FROM pages")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = node_table(pages(spark, sf_dir), "page_id")
    return nodes.groupBy("page_id").agg(F.count(F.when(F.col("kind") == "document", 1)).alias("roots"), F.count(F.when(F.col("norm") == "body", 1)).alias("bodies"))


@query("links_by_host", r"""
WITH a AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages)
SELECT host, count(*) AS links, count(DISTINCT href) AS targets FROM a GROUP BY host""")
def links_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(pages(spark, sf_dir, "a[href]"), "a[href]", "base_uri")
    return rows.groupBy(F.regexp_extract("base_uri", "://([^/?#]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct(H.attr(F.col("n"), "href")).alias("targets"))


def rows_only(name: str, f) -> None:
    query(name)(f)


rows_only("clean_pages", lambda spark, d: spread(table(spark, d, "pages")).select("page_id", H.clean_html(F.col("html"), "relaxed").alias("clean")))
rows_only("reformat_pages", lambda spark, d: spread(table(spark, d, "pages")).select("page_id", H.reformat_html(F.col("html")).alias("html")))
rows_only("edit_pages", lambda spark, d: spread(table(spark, d, "pages")).select("page_id", H.edit_html(F.col("html"), [("remove", "script, style, .ad"), ("attr", "a", "rel", "nofollow"), ("wrap", "article", "<main></main>")], out=Output(pretty=False)).alias("html")))
rows_only("css_paths", lambda spark, d: spread(table(spark, d, "pages")).select("page_id", F.explode(H.css_selectors(F.col("html"))).alias("path")))
rows_only("page_text", lambda spark, d: pages(spark, d, fields=("text",)).select("page_id", F.get("dom", F.lit(0))["text"].alias("text")))


# -- rows written as HTML and read back -----------------------------------------------


@query("part_table_cells", "SELECT p_brand, p_name AS name, p_size::VARCHAR AS size FROM part")
def part_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables without tbody: cells by class and by attribute of the same row."""
    df = parse_html(part_tables(spark, sf_dir), selectors=["tr"], nodes=("last", "text", "attr_map"))
    cell = lambda n, i: F.get(H.children(F.col("dom"), n), F.lit(i))
    return found(df, "tr", "p_brand", name=lambda n: cell(n, 0)["text"], size=lambda n: H.attr(cell(n, 1), "data-size"))


@query("part_table_position", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) SELECT p_brand, p_name AS name FROM t WHERE i % 3 = 2")
def part_table_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = "table > tbody > tr:nth-child(3n+2) > td.name"
    df = parse_html(part_tables(spark, sf_dir), selectors=[css], nodes=("text",))
    return matches(df, css, "p_brand").select("p_brand", F.col("n.text").alias("name"))


@query("orders_has", "SELECT l_orderkey, l_linenumber::VARCHAR AS line FROM lineitem WHERE l_linenumber % 2 = 1")
def orders_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(order_trees(spark, sf_dir), selectors=["li:has(b)"], nodes=("attr_map",))
    return matches(df, "li:has(b)", "l_orderkey").select("l_orderkey", F.col("n")["attr_map"]["data-line"].alias("line"))


@query("orders_not_has", "SELECT l_orderkey, l_linenumber::VARCHAR AS line FROM lineitem WHERE l_linenumber % 2 = 0")
def orders_not_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = "section > ol > li:not(:has(b))"
    df = parse_html(order_trees(spark, sf_dir), selectors=[css], nodes=("attr_map",))
    return matches(df, css, "l_orderkey").select("l_orderkey", F.col("n")["attr_map"]["data-line"].alias("line"))


@query("orders_joins_has", "SELECT l_orderkey, l_linenumber::VARCHAR AS line FROM lineitem WHERE l_linenumber % 2 = 1")
def orders_joins_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = "li:has(b)"
    nodes = node_table(parse_html(order_trees(spark, sf_dir), selectors=[css], nodes=(*relational.READ, "attr_map")), "l_orderkey")
    return relational.select(nodes, css, "l_orderkey").select("l_orderkey", F.col("attr_map")["data-line"].alias("line"))


@query(
    "orders_text",
    """SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag || ' odd' ELSE 'even ' || l_returnflag END, ' ' ORDER BY l_linenumber, l_linestatus, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey""",
)
def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a list: items are blocks, so a space stands between them."""
    df = parse_html(order_trees(spark, sf_dir), nodes=("kind", "norm", "text"))
    return df.select("l_orderkey", H.first_by_tag(F.col("dom"), "ol")["text"].alias("text"))


@query("orders_own_text", "SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'odd' ELSE 'even ' || l_returnflag END AS own FROM lineitem")
def orders_own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(order_trees(spark, sf_dir), selectors=["li"], nodes=("own_text",))
    return matches(df, "li", "l_orderkey").select("l_orderkey", F.col("n.own_text").alias("own"))


@query("orders_each_text", "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_linestatus, l_returnflag) AS flags FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY l_orderkey")
def orders_each_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(order_trees(spark, sf_dir), selectors=["b"], nodes=("text", "has_text"))
    flags = F.array_join(H.each_text(local.select(F.col("dom"), "b")), ",")
    return df.select("l_orderkey", F.explode(F.filter(F.array(flags), lambda x: x != "")).alias("flags"))  # a filter above would search each document again


@query("types_nth_of_type", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber) AS i FROM lineitem) SELECT l_orderkey, l_linenumber::VARCHAR AS line FROM t WHERE i = 2")
def types_nth_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = "em:nth-of-type(2), span:nth-of-type(2)"
    df = parse_html(mixed_types(spark, sf_dir), selectors=[css], nodes=("text",))
    return matches(df, css, "l_orderkey").select("l_orderkey", F.col("n.text").alias("line"))


@query("siblings", "SELECT n_regionkey, n_name AS name, count(*) OVER (PARTITION BY n_regionkey) - 1 AS others, lead(n_name) OVER w AS following, lag(n_name) OVER w AS previous FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(nation_lists(spark, sf_dir), fields=())
    dom = F.col("dom")
    named = lambda m: m["attr_map"]["title"]
    return found(df, "li", "n_regionkey", name=named, others=lambda n: F.size(H.siblings(dom, n)).cast("long"), following=lambda n: named(H.next_element(dom, n)), previous=lambda n: named(H.previous_element(dom, n)))


@query("parents", "SELECT n_regionkey, n_name AS name, 'ul,body,html' AS path FROM nation")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(nation_lists(spark, sf_dir), fields=("anc",))
    return found(df, "li", "n_regionkey", name=lambda n: n["attr_map"]["title"], path=lambda n: F.array_join(F.transform(H.parents(F.col("dom"), n), lambda m: m["norm"]), ","))


@query("children", "SELECT n_regionkey, count(*) AS items, string_agg('n' || n_nationkey, ' ' ORDER BY n_nationkey) AS ids FROM nation GROUP BY n_regionkey")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(nation_lists(spark, sf_dir), fields=())
    kids = H.children(F.col("dom"), H.first_by_tag(F.col("dom"), "ul"))
    return df.select("n_regionkey", F.size(kids).cast("long").alias("items"), F.array_join(F.transform(kids, lambda k: k["id_attr"]), " ").alias("ids"))


@query("dataset", "SELECT n_regionkey, n_nationkey::VARCHAR AS key, 1::BIGINT AS entries FROM nation")
def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(nation_lists(spark, sf_dir), fields=())
    data = H.dataset(F.col("n"))
    return matches(df, "li", "n_regionkey").select("n_regionkey", data["key"].alias("key"), F.size(data).cast("long").alias("entries"))


@query("except_matching", "SELECT n_regionkey, count(*) AS left_over FROM nation WHERE n_nationkey % 3 <> 1 GROUP BY n_regionkey")
def except_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(nation_lists(spark, sf_dir), fields=())
    els = H.except_matching(local.select(F.col("dom"), "li"), F.col("dom"), ".k1")
    return df.select("n_regionkey", F.size(els).cast("long").alias("left_over")).where("left_over > 0")


@query("escape", "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", H.escape(F.col("text")).alias("escaped"))


@query("escape_round_trip", "SELECT doc_id, text FROM documents")
def escape_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", H.unescape(H.escape(F.col("text"))).alias("text"))


@query("text_round_trip", r"SELECT doc_id, trim(regexp_replace(text, '[\t\n\r\f \x{00A0}]+', ' ', 'g')) AS text FROM documents")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("<p>"), H.escape(F.col("text")), F.lit("</p>")).alias("html"))
    return parse_html(df, fields=("text",)).select("doc_id", H.first_by_tag(F.col("dom"), "p")["text"].alias("text"))


@query("attribute_round_trip", "SELECT item_id, text FROM benchmark")
def attribute_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "benchmark").select("item_id", element("p", F.lit("x"), title=F.col("text")).alias("html"))
    return matches(parse_html(df, fields=()), "p", "item_id").select("item_id", H.attr(F.col("n"), "title").alias("text"))


@query("serialize_round_trip", "SELECT n_regionkey, count(*) AS items FROM nation GROUP BY n_regionkey")
def serialize_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, written and parsed again."""
    df = parse_html(nation_lists(spark, sf_dir), fields=())
    again = parse_html(df.select("n_regionkey", H.serialize(F.col("dom")).alias("html")), fields=())
    return again.select("n_regionkey", F.size(local.select(F.col("dom"), "li[id]")).cast("long").alias("items"))


@query("clean_dirty", "SELECT item_id, TRUE AS was_dirty, TRUE AS is_clean FROM benchmark")
def clean_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit('<p onclick="x()">'), H.escape(F.col("text")), F.lit('</p><script>bad()</script><a href="javascript:no()">a</a>'))
    df = table(spark, sf_dir, "benchmark").select("item_id", dirty.alias("dirty"))
    clean = H.clean_html(F.col("dirty"), "relaxed")
    return df.select("item_id", (~H.is_valid_html(F.col("dirty"), "relaxed")).alias("was_dirty"), H.is_valid_html(clean, "relaxed").alias("is_clean"))


@query("clean_to_text", r"SELECT item_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS clean FROM benchmark")
def clean_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("<b>"), H.escape(F.col("text")), F.lit("</b><script>x</script>")).alias("html"))
    return df.select("item_id", H.clean_html(F.col("html"), "none", out=Output(pretty=False)).alias("clean"))


@query("resolve_urls", "SELECT c_custkey, 'http://shop.example/c/' || c_custkey || '?x=1' AS url FROM customer")
def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", element("a", F.lit("x"), href=F.concat(F.lit("/c/"), F.col("c_custkey").cast("string"), F.lit("?x=1"))).alias("html"), F.lit("http://shop.example/a/b").alias("base"))
    rows = matches(parse_html(df, base_col="base", fields=()), "a", "c_custkey", "base_uri")
    return rows.select("c_custkey", H.abs_url(F.col("n"), F.col("base_uri"), "href").alias("url"))


@query("forms", "SELECT c_custkey, 2::BIGINT AS controls, c_mktsegment AS segment, c_name AS name FROM customer")
def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    html = F.concat(F.lit("<form><input name=n value="), F.lit('"'), H.escape(F.col("c_name"), True), F.lit('"><textarea name=s>'), H.escape(F.col("c_mktsegment")), F.lit("</textarea></form><input>"))
    df = parse_html(c.select("c_custkey", html.alias("html")), nodes=("kind", "norm", "attr_map", "form_owner", "text"))
    own = H.form_elements(F.col("dom"), H.first_by_tag(F.col("dom"), "form"))
    return df.select("c_custkey", F.size(own).cast("long").alias("controls"), H.val(F.get(own, F.lit(1))).alias("segment"), H.val(F.get(own, F.lit(0))).alias("name"))


@query("xml_parse", "SELECT n_regionkey, n_name AS name FROM nation")
def xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case is kept, nothing is implied; the declaration tells the parser."""
    n = table(spark, sf_dir, "nation")
    df = listing(n, "n_regionkey", "n_nationkey", element("Nation", F.lit(""), Name=F.col("n_name")), '<?xml version="1.0"?><Nations>', "</Nations>")
    rows = matches(parse_html(df, fields=("anc",)), "Nations Nation", "n_regionkey")
    return rows.where(F.col("n.name") == "Nation").select("n_regionkey", F.col("n.attrs")[0]["v"].alias("name"))


@query("edit_attributes", "SELECT n_regionkey, n_name AS name, 'nat k' || n_nationkey % 3 || ' new' AS classes FROM nation")
def edit_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nation_lists(spark, sf_dir).withColumn("html", H.edit_html(F.col("html"), [("add_class", "li", "new"), ("remove_attr", "li", "data-key"), ("remove", "p")]))
    rows = matches(parse_html(df, fields=()), "li:not([data-key])", "n_regionkey")
    return rows.select("n_regionkey", F.col("n")["attr_map"]["title"].alias("name"), F.array_join("n.classes", " ").alias("classes"))


# -- lookups, lists and axes -------------------------------------------------------------


def nation_query(name: str, which: str, find, fields=()):
    """find: dom -> elements of a nation list."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = parse_html(nation_lists(spark, sf_dir), fields=fields)
        return df.select("n_regionkey", F.explode(find(F.col("dom"))).alias("n")).select("n_regionkey", F.col("n")["attr_map"]["title"].alias("name"))

    query(name, numbered(which))(run)


def li(dom: Column) -> Column:
    return local.select(dom, "li")


nation_query("by_tag", "true", lambda d: K.by_tag(d, "LI"))
nation_query("by_id", "n_nationkey = 7", lambda d: K.by_id(d, "n7"))
nation_query("by_class", "n_nationkey % 3 = 2", lambda d: K.by_class(d, "K2"))
nation_query("by_attribute", "true", lambda d: K.by_attribute(d, "Data-Key"))
nation_query("by_attribute_starting", "true", lambda d: K.by_attribute_starting(d, "data-"))
nation_query("by_attribute_value", "name = 'NATION_3' OR name = 'FRANCE'", lambda d: L.union(d, K.by_attribute_value(d, "title", "nation_3"), K.by_attribute_value(d, "title", "france")))
nation_query("by_attribute_value_not", "name <> 'NATION_3'", lambda d: F.filter(K.by_attribute_value(d, "title", "NATION_3", "!="), lambda n: n["norm"] == "li"))
nation_query("by_attribute_value_ending", "name LIKE '%3'", lambda d: K.by_attribute_value(d, "title", "3", "$="))
nation_query("by_attribute_matching", "regexp_matches(name, '[0-4]$')", lambda d: K.by_attribute_matching(d, "title", "[0-4]$"))
nation_query("by_index_lt", "i <= 2", lambda d: F.filter(K.by_index(d, 2, "lt"), lambda n: n["norm"] == "li"))
nation_query("containing_own_text", "contains(name, '_1')", lambda d: K.containing_text(d, "_1", True), ("own_text",))
nation_query("matching_own_text", "regexp_matches(name, '_[0-9]$')", lambda d: K.matching_text(d, "_[0-9]$", True), ("own_text",))
nation_query("custom_condition", "n_nationkey > 11", lambda d: K.where(d, lambda n: n["attr_map"]["data-key"].cast("int") > 11))
nation_query("list_difference", "n_nationkey % 3 <> 0", lambda d: L.difference(d, li(d), K.by_class(d, "k0")))
nation_query("list_eq", "i = 3", lambda d: L.eq(li(d), 2))
nation_query("list_first_last", "i = 1 OR j = 1", lambda d: L.nodes(d, F.array_distinct(F.array(L.first(li(d))["pre"], L.last(li(d))["pre"]))))
nation_query("select_from_list", "n_nationkey % 3 = 1", lambda d: L.select_from(d, local.select(d, "ul, body, li"), "li.k1"), ("anc",))


@query("list_tests", "SELECT n_regionkey, bool_or(n_nationkey % 3 = 0) AS some, count(*) FILTER (n_nationkey % 3 = 0) > 0 AS meets, TRUE AS inside FROM nation GROUP BY n_regionkey")
def list_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(nation_lists(spark, sf_dir), fields=())
    d = F.col("dom")
    return df.select("n_regionkey", L.any_class(li(d), "K0").alias("some"), L.intersects(li(d), K.by_class(d, "k0")).alias("meets"), L.is_subset(K.by_class(d, "k0"), li(d)).alias("inside"))


@query("sibling_ends", "SELECT n_regionkey, n_name AS name, first_value(n_name) OVER w AS first, last_value(n_name) OVER w AS last FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def sibling_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, dom = parse_html(nation_lists(spark, sf_dir), fields=()), F.col("dom")
    named = lambda m: m["attr_map"]["title"]
    return found(df, "li", "n_regionkey", name=named, first=lambda n: named(L.first_sibling(dom, n)), last=lambda n: named(L.last_sibling(dom, n)))


@query("sibling_nodes", "WITH t AS (SELECT l_orderkey, l_linenumber % 2 AS odd FROM lineitem) SELECT l_orderkey, ' odd' AS following, count(*) AS n FROM t WHERE odd = 1 GROUP BY l_orderkey")
def sibling_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(order_trees(spark, sf_dir), selectors=["b"], nodes=("last", "content"))
    return found(df, "b", "l_orderkey", following=lambda n: L.next_node(F.col("dom"), n)["content"]).groupBy("l_orderkey", "following").agg(F.count(F.lit(1)).alias("n"))


@query("raw_text", "SELECT item_id, text FROM benchmark")
def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space as it stands."""
    df = table(spark, sf_dir, "benchmark").select("item_id", element("p", H.escape(F.col("text"))).alias("html"))
    return found(parse_html(df, fields=()), "p", "item_id", text=lambda n: L.raw_text(F.col("dom"), n))


@query("attribute_edits", """SELECT n_regionkey, ' class="x" title="' || n_name || '" new' AS html, 'x' AS class FROM nation""")
def attribute_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets, drops and adds attributes without leaving the JVM."""
    attrs = L.put(L.put(L.drop(F.col("n")["attrs"], "id", "DATA-KEY", ignore_case=True), "class", F.lit("x")), "new", None)
    rows = matches(parse_html(nation_lists(spark, sf_dir), fields=()), "li", "n_regionkey")
    in_order = F.concat(F.filter(attrs, lambda a: a["k"] == "class"), F.filter(attrs, lambda a: a["k"] != "class"))
    return rows.select("n_regionkey", L.as_html(in_order).alias("html"), L.get(attrs, "CLASS", True).alias("class"))


@query("traversal", "SELECT n_regionkey, 2 * (6 + 2 * count(*) + 1)::BIGINT AS steps, TRUE AS nested FROM nation GROUP BY n_regionkey")
def traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node is entered and left: document, html, head, body, p with its text, ul, and items with theirs."""
    steps = L.traversal(F.col("dom"))
    df = parse_html(nation_lists(spark, sf_dir), fields=()).select("n_regionkey", steps.alias("s"))
    first, last = F.get("s", F.lit(0)), F.get("s", F.size("s") - 1)
    return df.select("n_regionkey", F.size("s").cast("long").alias("steps"), ((first["pre"] == 0) & ~first["tail"] & (last["pre"] == 0) & last["tail"]).alias("nested"))


@query("whitespace_helpers", r"SELECT doc_id, regexp_replace(text, '[\t\n\r\f \x{00A0}]+', ' ', 'g') AS flat, trim(regexp_replace(text, '[\t\n\r\f]', ' ', 'g')) = '' AS blank, regexp_matches(text, '^[0-9]+$') AS digits FROM documents")
def whitespace_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", H.normalise_whitespace(t).alias("flat"), H.is_blank(t).alias("blank"), H.is_numeric(t).alias("digits"))


@query("fragment_parse", "SELECT n_regionkey, n_name AS name FROM nation")
def fragment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table body, parsed in its context."""
    n = table(spark, sf_dir, "nation")
    df = listing(n, "n_regionkey", "n_nationkey", element("tr", element("td", H.escape(F.col("n_name")))), "", "")
    return matches(parse_html(df, mode="fragment:tbody", fields=("text",)), "tr > td", "n_regionkey").select("n_regionkey", F.col("n.text").alias("name"))


@query("tag_traits", "SELECT n_regionkey, 5::BIGINT AS blocks, count(*) AS items FROM nation GROUP BY n_regionkey")
def tag_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """html, head, body, p and ul are blocks, and so are the items."""
    nodes = node_table(parse_html(nation_lists(spark, sf_dir), fields=()), "n_regionkey").where(F.col("kind") == "element")
    is_block = F.col("norm").isin(*BLOCK)
    return nodes.groupBy("n_regionkey").agg(F.count(F.when(is_block & (F.col("norm") != "li"), 1)).alias("blocks"), F.count(F.when(is_block & (F.col("norm") == "li"), 1)).alias("items"))


@query("validate", "SELECT item_id FROM benchmark WHERE item_id % 2 = 0")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("item_id") % 2 == 1, F.lit(' style="x"')).otherwise(F.lit(""))
    df = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("<p"), bad, F.lit(">"), H.escape(F.col("text")), F.lit("</p>")).alias("html"))
    return df.where(H.is_valid_html(F.col("html"), "basic")).select("item_id")


@query("decode_references", "SELECT n_nationkey, n_name || ' & <' || chr(169) || '> &nope; A' AS text FROM nation")
def decode_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", H.unescape(F.concat(F.col("n_name"), F.lit(" &amp; &lt;&copy;&#62; &nope; &#x41;"))).alias("text"))


@query("escape_ascii", "SELECT n_nationkey, n_name || '&eacute;&#x65b0;&lt;' AS text FROM nation")
def escape_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", H.escape_for(F.concat(F.col("n_name"), F.lit("é新<"))).alias("text"))


@query("sql_functions", "SELECT n_nationkey, n_name AS title, '<p>' || n_name || '</p>' AS clean FROM nation")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from SQL text."""
    H.register(spark)
    html = F.concat(F.lit("<title>"), F.col("n_name"), F.lit("</title><p onclick=x>"), F.col("n_name"), F.lit("</p>"))
    df = table(spark, sf_dir, "nation").select("n_nationkey", html.alias("html"), F.concat(F.lit("<p onclick=x>"), F.col("n_name")).alias("part"))
    return df.selectExpr("n_nationkey", "html_title(html) AS title", "html_clean_basic(part) AS clean")


@query("outer_html", """SELECT n_regionkey, string_agg('<li id="n' || n_nationkey || '" title="' || n_name || '" class="nat k' || n_nationkey % 3 || '" data-key="' || n_nationkey || '">' || n_name || '</li>', chr(10) ORDER BY n_nationkey) AS html, string_agg(n_name, '|' ORDER BY n_nationkey) AS inner_html FROM nation GROUP BY n_regionkey""")
def outer_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(nation_lists(spark, sf_dir), fields=())
    pres = L.numbers(li(F.col("dom")))
    return df.select("n_regionkey", F.array_join(H.html_of(F.col("dom"), pres), "\n").alias("html"), F.array_join(H.html_of(F.col("dom"), pres, inner=True), "|").alias("inner_html"))


@query("joined_text", "SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag || ' odd' ELSE 'even ' || l_returnflag END, ' ' ORDER BY l_linenumber, l_linestatus, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse_html(order_trees(spark, sf_dir), selectors=["li"], nodes=("text",))
    return df.select("l_orderkey", H.joined_text(li(F.col("dom"))).alias("text"))


@query("body_fragment", "SELECT item_id, 4::BIGINT AS nodes, text FROM benchmark")
def body_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment stands in a shell of html, head and body."""
    df = table(spark, sf_dir, "benchmark").select("item_id", element("pre", H.escape(F.col("text"))).alias("html"))
    parsed = parse_html(df, mode="fragment", fields=())
    elements = F.size(F.filter("dom", lambda n: n["kind"] == "element")).cast("long")
    return parsed.select("item_id", elements.alias("nodes"), L.raw_text(F.col("dom"), H.first_by_tag(F.col("dom"), "pre")).alias("text"))


@query("doctype_and_quirks", "SELECT page_id, 'html' AS doctype, 'no' AS quirks FROM pages")
def doctype_and_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    return df.select("page_id", L.first(F.filter("dom", lambda n: n["kind"] == "doctype"))["name"].alias("doctype"), "quirks")


@query("page_titles", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), ''), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; a reference may lack its semicolon where text was cut off."""
    whole = table(spark, sf_dir, "pages").select("page_id", "html")
    return parse_html(whole, fields=("text",)).select("page_id", H.title(F.col("dom")).alias("title"))


@query("clean_policies", """SELECT item_id, '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' AS basic, '<b>x</b>' AS simple, '<img src="http://h/a.png" />' AS images FROM benchmark""")
def clean_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = Output(pretty=False)
    df = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("<div><p class=a>"), H.escape(F.col("text")), F.lit("</p></div>")).alias("html"))
    return df.select("item_id", H.clean_html(F.col("html"), "basic", out=flat).alias("basic"), H.clean_html(F.lit("<p><b onclick=y>x</b></p>"), "simple_text", out=flat).alias("simple"), H.clean_html(F.lit("<img src='http://h/a.png' onerror=x>"), "basic_with_images", out=flat).alias("images"))
