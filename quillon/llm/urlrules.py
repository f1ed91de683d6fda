"""URL rules with redirect equivalence.

A page's address is equivalent to what its canonical link and its refresh redirect name. Distributed connected components over these edges
find the aliases; a block that a rule gives to one of them holds for all that no rule fits themselves, unless a rule explicitly allows one of them.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, small_batches, table
from quillon.operators.graph import components

#: (verdict, host/path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in small letters, and the path; both empty if the url is null or has no "://"."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), CAPITALS, CAPITALS.lower()), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of rules of one length the first in order of the alphabet is meant."""
    name = verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


#: The ports that a scheme stands for.
PORTS = {"http": "80", "https": "443"}


def _part(url: Column, k: int) -> Column:
    """1: the scheme with its colon; 2: the slashes and the host; 3: the path; 4: the query with its mark. Empty where there is none."""
    return F.regexp_extract(url, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*:(?=//))?(//[^/?#]*)?([^?#]*)(\?[^#]*)?", k)


def _without_dots(path: Column) -> Column:
    """A path whose "." and ".." are resolved (RFC 3986, 5.2.4)."""
    steps = F.split(path, "/", -1)
    last = F.element_at(steps, -1)
    walk = F.aggregate(
        F.filter(steps, lambda x, i: (i > 0) & (x != ".")),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x != "..", F.array_append(done, x)).otherwise(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))),
    )
    return F.concat(F.lit("/"), F.array_join(walk, "/"), F.when(last.isin(".", "..") & (F.size(walk) > 0), "/").otherwise(""))


def _node(url: Column) -> Column:
    """An address in one spelling: scheme and host in small letters, without the scheme's own port, dots in the path and the fragment; "/" for an empty path."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[\t\n\r]", ""), " ", "%20")  # as browsers read them
    scheme, host = F.lower(_part(bare, 1)), F.translate(_part(bare, 2), CAPITALS, CAPITALS.lower())
    for name, port in PORTS.items():
        host = F.when(scheme == f"{name}:", F.regexp_replace(host, f":(?:{port})?$", "")).otherwise(host)
    path = _part(bare, 3)
    return F.when(host == "", F.regexp_replace(bare, r"(?s)#.*\z", "")).otherwise(F.concat(scheme, host, F.when(path.contains("/."), _without_dots(path)).when(path == "", "/").otherwise(path), _part(bare, 4)))


def _resolved(to: Column, base: Column) -> Column:
    """Where a link of the page at base leads (RFC 3986, 5.2.2); null for links of other schemes, such as mailto."""
    root = F.concat(_part(base, 1), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), r"(?s)[^/]*\z", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(_part(base, 1), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, _part(base, 3), to))
        .when(to.startswith("#"), base)
        .otherwise(F.concat(root, folder, to))
    )


#: What holds no tags: comments, and elements of raw text.
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1\s*>|\Z)", re.I | re.S)
#: A value of an attribute ends with the quote that opened it; without one, at white space or the tag's end.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
TAG = re.compile(rf"<(link|meta|base)(?=[\s/>])((?:=\s*+{VALUE}?|[^>=]++)*+)>", re.I)
ATTRIBUTE = re.compile(rf"""([^\s"'>/=<]++)(?:\s*+=\s*+({VALUE}))?+""")
#: What follows the seconds and "url=" in the content of a refresh.
REFRESH = re.compile(r"\s*[0-9]*(?:\.[0-9]*)?\s*[;,]?\s*(?:url\s*=\s*)?(.*)", re.I | re.S)


def _told(url: str, page: str) -> list[tuple[str, str]]:
    """(address that links are relative to, link) for what a page names as canonical or redirects to."""
    base, found = None, []
    for kind, rest in TAG.findall(RAW.sub("", page)):
        attributes: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(rest):
            attributes.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value).strip())
        kind = kind.lower()
        if kind == "base" and base is None and attributes.get("href"):
            base = attributes["href"]
        elif kind == "link" and "canonical" in attributes.get("rel", "").lower().split():
            found.append(attributes.get("href", ""))
        elif kind == "meta" and attributes.get("http-equiv", "").lower() == "refresh":
            to = REFRESH.match(attributes.get("content", ""))[1].strip()
            found.append(to[1:].split(to[0])[0] if to[:1] in ("'", '"') else to)
    try:
        home = urljoin(url, base or "")
    except ValueError:  # no address at all
        home = url
    return [(home, to) for to in found if to]


def _scan(batches):
    names = ["url", "base", "to"]
    for batch in batches:
        rows = [(url, base, to) for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True) for base, to in _told(url, page)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=names)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): the address of each page and those that it names as canonical or redirects to, all in one spelling.

    Tags in comments and in raw text don't count; rel is a list of words in any case; of repeated attributes the first counts. Relative links are resolved against the first <base> with an address, which
    itself is resolved against the page's own. Only pages with such a tag go to Python.
    """
    small_batches(pages.sparkSession)
    some = pages.where(F.col(url_col).contains("://") & F.col(html_col).rlike("(?i)<(?:link|meta)[\\s/>]")).select(F.trim(url_col).alias("url"), F.col(html_col).alias("html"))
    found = some.mapInArrow(_scan, "url string, base string, to string")
    return found.select(_node(F.col("url")).alias("a"), _node(_resolved(F.col("to"), F.col("base"))).alias("b")).where("b IS NOT NULL")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, alias_verdict) for every row.

    alias_verdict is what the aliases hand on: allow if a rule allows one of them, else block if a rule blocks one, else null.
    A page that no rule fits gets it, or allow. Null pages and urls have no host, no path and no aliases; null html has no links.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_says", says).withColumn("_node", _node(F.col("_url")))
    edges = cut(links(pages, url_col, html_col).distinct())
    known = components(edges, "a", "b")
    node_host, node_path = host_and_path(F.col("node"))
    _, node_says = rule_of(node_host, node_path, rules)
    told = known.select("node", "component", node_says.alias("says"))
    handed = told.groupBy("component").agg(F.min("says").alias("alias_verdict"))  # allow is before block
    of_node = cut(told.join(handed.where("alias_verdict IS NOT NULL"), "component").select(F.col("node").alias("_node"), "alias_verdict"))
    if of_node.isEmpty():
        joined = rows.withColumn("alias_verdict", F.lit(None).cast("string"))
    else:
        joined = rows.join(of_node, "_node", "left")
    return joined.select(id_col, "host", "path", "rule", F.coalesce("_says", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict")


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("alias_verdict")


_HOST = r"lower(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1))"
_PATH = r"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_FITS = "SELECT {k}, r.rule, r.verdict FROM {t} t JOIN rules r ON (t.host = r.top OR ends_with(t.host, '.' || r.top)) AND starts_with(t.path, r.rest) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY length(r.rule) DESC) = 1"

QUERIES = {"op6_url_rules": op6_url_rules}
#: The rules and the aliases. The canonical links and redirects are read with simpler patterns than above, and addresses taken as they are spelled, for the forms that pages have.
ORACLES = {
    "op6_url_rules": f"""
WITH RECURSIVE rules(verdict, rule, top, rest) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
p AS (SELECT page_id, regexp_replace(trim(url), '#.*', '') AS node, coalesce({_HOST.format(u='url')}, '') AS host, coalesce({_PATH.format(u='url')}, '') AS path FROM pages),
tags AS (SELECT regexp_replace(trim(url), '#.*', '') AS a, unnest(regexp_extract_all(html, '(?i)<(link|meta)\\b[^>]*>')) AS tag FROM pages),
told AS (SELECT a, CASE WHEN regexp_matches(tag, '(?i)rel=["'']?canonical') THEN regexp_extract(tag, '(?i)href=["'']?([^"'' >]+)', 1) WHEN regexp_matches(tag, '(?i)http-equiv=["'']?refresh') THEN regexp_extract(tag, '(?i)url=["'']?([^"'' >]+)', 1) ELSE '' END AS b FROM tags),
edges AS (SELECT a, regexp_replace(b, '#.*', '') AS b FROM told WHERE contains(b, '://')),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS r FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
nodes AS (SELECT DISTINCT r AS node, coalesce({_HOST.format(u='r')}, '') AS host, coalesce({_PATH.format(u='r')}, '') AS path FROM reach),
node_rule AS ({_FITS.format(k='t.node', t='nodes')}),
handed AS (SELECT reach.node, min(node_rule.verdict) AS verdict FROM reach JOIN node_rule ON node_rule.node = reach.r GROUP BY reach.node),
own AS ({_FITS.format(k='t.page_id', t='p')})
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.verdict, handed.verdict, 'allow') AS verdict FROM p LEFT JOIN own USING (page_id) LEFT JOIN handed ON handed.node = p.node
"""
}
