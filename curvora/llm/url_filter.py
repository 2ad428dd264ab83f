"""URL filters with redirect equivalence.

Rules name a host with its subdomains and a path prefix.  URLs that redirect to one another or name one another as
canonical are aliases: edges between them are kept in a distributed table, its connected components are the classes, and
a block found on one member holds for all members without a rule of their own.  Allow has precedence: a page's own rule
always holds, and a class with an explicitly allowed member takes no block from another.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules that are inlined into the plan at most; more are joined on the host.
INLINE_RULES = 200
# The query's rules, parameters that only track visits.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
TAG = r"""(?is)<(?:link|meta)(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*+>"""
ATTRIBUTES = r"""(?is)[^\s/"'>=<]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&#0*39;", "'"), ("&#[xX]0*27;", "'"), ("&#0*47;", "/"), ("&#[xX]0*2[fF];", "/"), ("&#0*61;", "="), ("&#[xX]0*3[dD];", "="), ("&lt;", "<"), ("&gt;", ">"), ("&(?:amp|#0*38|#[xX]0*26);", "&"))


def host_of(url: F.Column) -> F.Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def with_rule(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """urls has host and path; adds rule (its name) and rule_verdict, null where no rule fits.  The longest rule wins."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    if len(ordered) <= INLINE_RULES:
        best = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
        for r in reversed(ordered):
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            best = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("rule_verdict"))).otherwise(best)
        return urls.withColumn("__best", best).select(*urls.columns, "__best.rule", "__best.rule_verdict")
    table = urls.sparkSession.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in ordered], "r_host string, r_path string, r_name string, r_verdict string")
    rows = materialise(urls.withColumn("__row", F.monotonically_increasing_id()), "url-rows")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = rows.select("__row", "path", F.explode(suffixes).alias("suffix")).join(table, F.col("suffix") == F.col("r_host")).where(F.col("path").startswith(F.col("r_path")))
    best = found.groupBy(F.col("__row").alias("__r")).agg(F.min(F.struct((-F.length("r_name")).alias("l"), F.col("r_name"), F.col("r_verdict"))).alias("b"))
    return rows.join(best, rows["__row"] == best["__r"], "left").select(*urls.columns, F.col("b.r_name").alias("rule"), F.col("b.r_verdict").alias("rule_verdict"))


def canonical_form(url: F.Column) -> F.Column:
    """Without fragment and tracking parameters."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    bare = F.regexp_replace(bare, rf"(?<=[?&])(?:{TRACKING})=[^&]*&?", "")
    return F.regexp_replace(bare, "[?&]$", "")


def absolute(link: F.Column, base: F.Column) -> F.Column:
    """A link of a page as a URL, resolved against the page's own (RFC 3986, 5.2); null for an empty link."""
    site = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "(?s)^(.*?:)//", 1)
    path, bare = F.regexp_extract(base, URL, 2), F.regexp_replace(base, "(?s)#.*$", "")
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "(?s)[^/]*$", ""))
    own = F.regexp_extract(link, "(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(link, "(?s)^[^?#]*(.*)$", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))

    def step(done: F.Column, part: F.Column) -> F.Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.split(F.substr(whole, F.lit(2)), "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(parts, F.lit(""))).otherwise(parts)
    dots = F.exists(parts, lambda part: part.isin(".", ".."))  # only then a path is walked part by part
    clean = F.concat(F.lit("/"), F.array_join(F.when(dots, F.reduce(parts, F.array().cast("array<string>"), step)).otherwise(parts), "/"))
    resolved = F.concat(site, clean, tail)
    return (
        F.when(link == "", None).when(link.rlike("(?i)^[a-z][a-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link))
        .when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None).when(link.startswith("?"), F.concat(site, path, link)).when(link.startswith("#"), F.concat(bare, link)).otherwise(resolved)
    )


def tag_links(html: F.Column) -> F.Column:
    """Targets of all canonical links and refreshes of a page, as they are written, entities decoded."""

    def value(tag: F.Column, name: str) -> F.Column:
        own = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTES), F.lit(0)), lambda x: x.rlike(rf"(?is)^{name}\s*="))
        text = F.regexp_replace(F.regexp_replace(F.get(own, F.lit(0)), r"(?s)^[^=]*=\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
        for entity, sign in ENTITIES:
            text = F.regexp_replace(text, entity, sign)
        return F.trim(F.regexp_replace(text, r"[\t\r\n]", " "))

    def target(tag: F.Column) -> F.Column:
        url = F.regexp_extract(value(tag, "content"), r"""(?is)^[\s\d.]*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*?)["']?\s*$""", 1)
        canonical = tag.rlike("(?i)^<link") & value(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
        return F.when(canonical, value(tag, "href")).when(tag.rlike("(?i)^<meta") & (F.lower(value(tag, "http-equiv")) == "refresh"), url)

    return F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), target))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs: each page's canonical links and refresh targets, and its own canonical form."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    links = F.transform(tag_links(html), lambda link: absolute(link, url))
    targets = F.concat(F.array(canonical_form(url)), links)
    edges = pages.where(url.contains("://")).select(url.alias("src"), F.explode(F.array_compact(targets)).alias("dst"))
    return edges.where("dst != '' and src != dst")


def judge(pages: DataFrame, rules: tuple[Rule, ...], redirects: DataFrame | None = None) -> DataFrame:
    """Judge every page (page_id, url, html): page_id, host, path, rule, verdict, class_url (least URL of its class).

    ``redirects`` (src, dst URLs) adds edges.  Defined cases: a null url, or one without ``://``, has an empty host and
    path, fits no rule, has no aliases and is allowed; a null html has no links; repeated pages and null page_ids are
    judged row by row; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    edges = alias_edges(rows)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
    classes = materialise(connected_components(edges.distinct()), "url-classes")
    # Every member's own verdict, whether or not it is among the pages.
    members = with_rule(classes.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    marks = members.groupBy("component").agg(F.max(F.col("rule_verdict") == "block").alias("blocked"), F.max(F.col("rule_verdict") == "allow").alias("allowed"))
    marks = marks.select(F.col("component").alias("m_c"), (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("spread"))
    spread = classes.join(marks, F.col("component") == F.col("m_c")).select(F.col("node").alias("m_url"), F.col("component").alias("class_url"), "spread")
    own = with_rule(rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    both = own.join(spread, own["url"] == spread["m_url"], "left")
    verdict = F.coalesce("rule_verdict", F.when(F.coalesce("spread", F.lit(False)), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("class_url", "url").alias("class_url"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _case(column: str) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    value = (lambda r: r.name) if column == "rule" else (lambda r: r.verdict)
    return "case " + " ".join(f"when (host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}') then '{value(r)}'" for r in ordered) + " end"


_PARTS = rf"""translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) path"""
ORACLE = rf"""
with recursive u as (select page_id, url, coalesce(html, '') html from pages),
f as (select url src, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', '', 's'), '([?&])(?:{TRACKING})=[^&]*&?', '\1', 'g'), '[?&]$', '') dst from u where url like '%://%'),
e as (select src, dst from f where src != dst and dst != ''),
sym as (select src a, dst b from e union select dst, src from e),
reach(a, b) as (select a, a from sym union select r.a, t.b from reach r join sym t on r.b = t.a),
ruled as (select url, {_case("verdict")} v from (select distinct b url, {_PARTS.replace("url,", "b,")} from reach)),
spread as (select reach.a url, bool_or(v = 'block') and not coalesce(bool_or(v = 'allow'), false) s from reach join ruled on reach.b = ruled.url group by reach.a),
own as (select page_id, url, {_PARTS} from u)
select page_id, host, path, {_case("rule")} "rule", coalesce({_case("verdict")}, case when spread.s then 'block' else 'allow' end) verdict
from own left join spread using (url)
"""
