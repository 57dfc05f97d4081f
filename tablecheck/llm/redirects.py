"""URL filters over redirect equivalence.

Explicit rules judge a page by host suffix and path prefix. Pages that redirect or point to each other (meta refresh,
`rel="canonical"`) and spellings of one address (scheme, `www.`, `m.`, tracking parameters, fragment, final slash or
`.html`) are equivalent: distributed connected components over those edges carry a block to all aliases. An explicit
allow anywhere in a component takes precedence over a block there; a page's own rule always decides for itself. Rules
are applied to link targets as well, whether or not they are rows. Relative targets are resolved against the first
`<base>` of the page, or its url; targets of other kinds (`mailto:`) are no pages. Entities (`&amp;`, `&#38;`) in targets are read
as HTML reads them, as far as addresses need them.

Defined cases: a null url, or one without `://`, has empty host and path and no rule; a null html has no edges; html of any
length is read whole; a page without any rule in its component is allowed; repeated rows give repeated results; rows that
share a page_id are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected

#: Action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Query parameters that do not change what an address shows.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
#: Tags that hold links or the address they start from; an attribute in any quotes or none; what comes before a refresh's target.
TAG = r"""(?i)<(?:link|meta|base)(?=[\s/"'])(?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+"""
ATTRIBUTE = r"""[^\s"'<>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|["'][^"'>]*+|[^\s"'>][^\s>]*+)"""
REFRESH = r"(?is)^\s*(?:[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?|url\s*=\s*)(\S.*)$"


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substr(_u, locate('://', _u) + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substr(_u, locate('://', _u) + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: str) -> Column:
    """The address without scheme: what edges connect."""
    text = F.regexp_replace(F.col(url), r"(?s)^[^:/?#]*://|#.*$", "")
    return F.concat(F.lower(F.regexp_extract(text, r"^[^/?]*", 0)), F.regexp_extract(text, r"(?s)^[^/?]*(.*)$", 1))


def canonical_of(node: str) -> Column:
    """One spelling for all spellings of an address."""
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(F.col(node), r"(?s)^[^?]*\?(.*)$", 1)), f"&(?:{TRACKING})=[^&]*", "")
    query = F.regexp_replace(F.regexp_replace(query, "&{2,}", "&"), "^&|&$", "")
    text = F.concat(F.regexp_extract(F.col(node), r"^[^?]*", 0), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    text = F.regexp_replace(text, r"^(?:www|m|amp)\.", "")
    return F.regexp_replace(text, r"(?:\.html?|/)$", "")


def value_of(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes; null if it has none."""
    first = F.get(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda x: x.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    return unquoted(F.regexp_replace(first, r"^[^=]*=\s*", ""))


#: Entities that stand for characters of addresses, as names and code points.
ENTITIES = (("quot", 34), ("apos", 39), ("sol", 47), ("colon", 58), ("equals", 61), ("quest", 63), ("period", 46), ("num", 35), ("amp", 38))


def without_entities(text: Column) -> Column:
    """Entities of the characters above turned into them; that of the ampersand last, so that nothing is read twice."""
    for name, code in ENTITIES:
        text = F.regexp_replace(text, f"&(?:{name}|#0*{code}|#[xX]0*(?i:{code:x}));", "\\" + chr(code))
    return text


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"""(?s)^(?:"([^"]*).*|'([^']*).*)$""", "$1$2")


def resolved(target: Column, base: Column) -> Column:
    """The absolute address of a link on a page at base; null if it names no page."""
    to = F.regexp_replace(F.regexp_replace(target, r"[\t\r\n]", ""), r"^ +| +$", "")
    scheme, site = F.regexp_extract(base, r"^([^:/?#]*:)//", 1), F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"(?s)^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    tail = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    inside = F.regexp_extract(to, r"^[^?#]*", 0)
    return (
        F.when(to.rlike(r"^[^:/?#]+://"), to)
        .when((to == "") | to.startswith("#") | to.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (site == ""), None)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("/"), F.concat(site, without_dots(inside), tail))
        .when(to.startswith("?"), F.concat(site, path, to))
        .otherwise(F.concat(site, without_dots(F.concat(folder, inside)), tail))
    )


def without_dots(path: Column) -> Column:
    """An absolute path with its `.` and `..` steps taken."""
    steps = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    taken = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(taken, "/"))).otherwise(path)


def links(pages: DataFrame) -> DataFrame:
    """_alias, _u (absolute target) for each canonical link and meta refresh of pages (_alias, _url, _html)."""
    tags = F.regexp_extract_all(F.col("_html"), F.lit(TAG), F.lit(0))
    rows = pages.where(F.col("_html").rlike("(?i)canonical|refresh")).select("_alias", "_url", tags.alias("_tags"))
    base = F.get(F.filter(F.transform(F.filter("_tags", lambda t: t.rlike("(?i)^<base")), lambda t: value_of(t, "href")), lambda x: x.isNotNull()), F.lit(0))
    rows = rows.select("_alias", "_url", base.alias("_base"), F.explode("_tags").alias("_tag")).where(F.col("_tag").rlike("(?i)canonical|refresh"))
    tag = F.col("_tag")
    refresh = F.when(F.lower(F.trim(value_of(tag, "http-equiv"))) == "refresh", unquoted(F.regexp_extract(value_of(tag, "content"), REFRESH, 1)))
    canonical = F.when(value_of(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:[\s/]|$)"), value_of(tag, "href"))
    rows = rows.select("_alias", F.coalesce(resolved(F.col("_base"), F.col("_url")), "_url").alias("_from"), F.when(tag.rlike("(?i)^<meta"), refresh).when(tag.rlike("(?i)^<link"), canonical).alias("_to"))
    return rows.select("_alias", resolved(without_entities(F.col("_to")), F.col("_from")).alias("_u")).where("_u is not null")


def rule_of(host: str, path: str, rules=RULES) -> Column:
    """The longest rule that fits, as action and text; null if none does. Ties go to allow, then to the text."""
    found = [
        F.when(
            ((F.col(host) == F.lit(h)) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(int(action == "allow")).alias("allow"), F.lit(h + p).alias("rule")),
        )
        for action, h, p in rules
    ]
    return F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, component for each row of pages (page_id, url, html)."""
    own = (
        pages.select("page_id", F.col("url").alias("_u"), F.col("html").alias("_html"))
        .select("page_id", host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path"), node_of("_u").alias("_node"), F.col("_u").alias("_url"), "_html")
        .withColumn("_rule", rule_of("host", "path", rules))
        .withColumn("_alias", F.md5(canonical_of("_node")))
    )
    # spellings of one address meet in one node; only pages that point elsewhere need components
    aimed = links(own.where(F.col("_alias").isNotNull()).select("_alias", "_url", "_html"))
    aimed = aimed.select("_alias", host_of(F.col("_u")).alias("_host"), path_of(F.col("_u")).alias("_path"), node_of("_u").alias("_t"))
    aimed = aimed.select(F.col("_alias").alias("a"), F.md5(canonical_of("_t")).alias("b"), rule_of("_host", "_path", rules)["allow"].alias("allow"))
    aimed = written(aimed.distinct())
    groups = connected(aimed.select("a", "b")).select(F.col("node").alias("_alias"), F.col("component").alias("_group"))
    placed = own.drop("_node", "_url", "_html").join(groups, "_alias", "left").withColumn("component", F.coalesce("_group", "_alias"))
    # a target has a say even if it is no row; one row for each target, so that a hub is joined once
    targets = aimed.where("allow is not null").groupBy(F.col("b").alias("_alias")).agg(F.max("allow").alias("_allow"))
    targets = targets.join(groups, "_alias", "left").select(F.coalesce("_group", "_alias").alias("component"), "_allow")
    # (written, so that both sides of the join are dealt anew and a hot component's rows can be split)
    said = written(
        placed.where(F.col("_rule").isNotNull() & F.col("component").isNotNull())
        .select("component", F.col("_rule.allow").alias("_allow"))
        .union(targets)
        .groupBy("component")
        .agg(F.max("_allow").alias("_allow"))
    )
    known = F.when(F.col("_rule").isNotNull(), F.col("_rule.allow")).otherwise(F.coalesce(F.col("_allow"), F.lit(1)))
    return placed.join(said, "component", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.when(known == 1, "allow").otherwise("block").alias("verdict"), "component"
    )


#: One spelling of an address x: its address and its parameters apart.
_PARAMETERS = "list_filter(string_split(substr({x}, instr({x}, '?') + 1), '&'), lambda p: p <> '' AND NOT regexp_full_match(p, '(utm_[a-z]+|gclid|fbclid|ref)=.*'))"
_SPELLING = (
    "regexp_replace(regexp_replace(CASE WHEN instr({x}, '?') = 0 THEN {x} WHEN len(" + _PARAMETERS + ") = 0 THEN split_part({x}, '?', 1) "
    "ELSE split_part({x}, '?', 1) || '?' || array_to_string(" + _PARAMETERS + ", '&') END, '^(?:www|m|amp)\\.', ''), '(?:\\.html?|/)$', '')"
)
#: judge() without component, in DuckDB SQL; rules are written out, tracking parameters are dropped from a list, and links are absolute targets in plain forms.
ORACLE_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
  regexp_replace(url, '(?s)^[^:/?#]*://|#.*$', '', 'g') AS bare FROM pages),
n AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
  lower(regexp_extract(bare, '^[^/?]*')) || regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1) AS node FROM u),
o AS (SELECT *, {_SPELLING.format(x='node')} AS alias,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM n),
l AS (SELECT alias, unnest(list_concat(regexp_extract_all(html, '(?i)<link[^>]*rel=["'']?canonical["'']?[^>]*href=["'']([^"''>]+)', 1), regexp_extract_all(html, '(?i)<link[^>]*href=["'']([^"''>]+)["''][^>]*rel=["'']?canonical', 1),
  regexp_extract_all(html, '(?i)<meta[^>]*http-equiv=["'']?refresh["'']?[^>]*url=([^"''>\\s]+)', 1))) AS t FROM o),
t AS (SELECT a, lower(regexp_extract(bare, '^[^/?]*')) || regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1) AS node FROM (SELECT alias AS a, regexp_replace(t, '(?s)^[^:/?#]*://|#.*$', '', 'g') AS bare FROM l WHERE contains(t, '://'))),
e AS (SELECT a, {_SPELLING.format(x='node')} AS b FROM t),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a),
g AS (SELECT o.*, coalesce(c.component, o.alias) AS component FROM o LEFT JOIN c ON o.alias = c.a),
v AS (SELECT component, max(CAST(rule IN ('example.net/en/', 'org/fr/') AS INTEGER)) AS allow FROM g WHERE rule IS NOT NULL AND component IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule, CASE WHEN coalesce(CAST(rule IN ('example.net/en/', 'org/fr/') AS INTEGER), v.allow, 1) = 1 THEN 'allow' ELSE 'block' END AS verdict FROM g LEFT JOIN v ON g.component = v.component
"""
