"""URL rules whose block decisions reach aliases through redirects and canonical links (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, release
from .graph import components

#: Above so many rules they are joined as a table; up to it they travel as one constant.
INLINE_RULES = 64


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + F.lit(3), F.lit(2**31 - 1)), "#", 1)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-cased text between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?]*([^?]*)", 1), F.lit(""))


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Add ``host`` and ``path`` of column ``url``."""
    return df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))


def url_key(url: Column) -> Column:
    """The form under which two spellings of a url are one node: lower-cased scheme and host, no fragment."""
    return F.concat(ascii_lower(F.substring_index(url, "://", 1)), F.lit("://"), host_of(url), F.regexp_replace(_rest(url), r"^[^/?]*", ""))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str]], key: str) -> DataFrame:
    """Add ``rule`` and ``action`` of the longest fitting rule to rows that have ``host``, ``path`` and a unique ``key``.

    A rule is (action, "host/path"); it fits its host and all subdomains if the path starts with the rule's.
    Ties of length go to the greater rule text. Without a fitting rule both are null.
    """
    parts = [(action, text, text.partition("/")[0], "/" + text.partition("/")[2]) for action, text in rules]
    best = "struct<size:int,rule:string,action:string>"
    if len(parts) <= INLINE_RULES:
        fits = [
            F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path), F.struct(F.lit(len(text)).alias("size"), F.lit(text).alias("rule"), F.lit(action).alias("action")))
            for action, text, host, path in parts
        ]
        won = F.greatest(*fits, F.lit(None).cast(best), F.lit(None).cast(best))
        return urls.withColumn("_won", won).withColumns({"rule": F.col("_won.rule"), "action": F.col("_won.action")}).drop("_won")
    table = urls.sparkSession.createDataFrame(parts, "action string, rule string, suffix string, prefix string")
    won = (
        urls.select(key, "path", F.explode(_suffixes(F.col("host"))).alias("suffix"))
        .join(table, "suffix")
        .where(F.col("path").startswith(F.col("prefix")))
        .groupBy(key)
        .agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "action")).alias("_won"))
    )
    return urls.join(won, key, "left").withColumns({"rule": F.col("_won.rule"), "action": F.col("_won.action")}).drop("_won")


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"'>]*)[\"']", 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*([^\s\"'>]+)", 1))


def _decoded(value: Column) -> Column:
    """An attribute's value with the character references that urls need; ``&amp;`` last, so nothing is decoded twice."""
    for reference, char in (("&#x2[fF];|&#47;|&sol;", "/"), ("&#x3[aA];|&#58;|&colon;", ":"), ("&#x3[fF];|&#63;|&quest;", "?"), ("&#x3[dD];|&#61;|&equals;", "="), ("&#x2[eE];|&#46;|&period;", "."), ("&amp;|&#x26;|&#38;", "&")):
        value = F.regexp_replace(value, reference, char)
    return F.trim(value)


def _without_dots(url: Column) -> Column:
    """A url whose path has no ``.`` and ``..`` segments; ``..`` at the root stays there."""
    front = F.concat(F.substring_index(url, "://", 1), F.lit("://"), F.regexp_extract(_rest(url), r"^[^/?]*", 0))
    path, query = path_of(url), F.regexp_extract(_rest(url), r"\?.*$", 0)
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x))
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    # A path that ends in a dot segment names a folder.
    end = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(front, F.lit("/"), F.array_join(kept, "/"), end, query)).otherwise(url)


def _resolved(df: DataFrame, to: str, source: str, name: str) -> DataFrame:
    """Add ``name``: column ``to`` resolved against the url in column ``source``; each step is a column of its own, so none is worked out twice."""
    ref, base = F.col(to), F.col(source)
    df = df.withColumn("_scheme", F.substring_index(base, "://", 1)).withColumn("_host", host_of(base)).withColumn("_path", path_of(base))
    front = F.concat("_scheme", F.lit("://"), "_host")
    joined = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(ref.startswith("//"), F.concat("_scheme", F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(front, ref))
        .when(ref.startswith("?"), F.concat(front, "_path", ref))
        .otherwise(F.concat(front, F.regexp_replace("_path", r"[^/]*$", ""), F.when(F.col("_path").contains("/"), F.lit("")).otherwise(F.lit("/")), ref))
    )
    df = df.withColumn("_joined", joined)
    dotted = F.col("_joined").contains("://") & F.col("_joined").rlike(r"/\.{1,2}([/?#]|$)")
    return df.withColumn(name, F.when(dotted, _without_dots(F.col("_joined"))).otherwise(F.col("_joined"))).drop("_scheme", "_host", "_path", "_joined")


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (``from_url``, ``to_url``) that pages declare: canonical links and meta refreshes, made absolute.

    Comments and the contents of scripts and styles don't count. Character references are decoded, and relative urls
    are resolved against the page's ``<base href>``, if it has one, else its own url; ``.`` and ``..`` segments go.
    """
    html, url = F.col("html"), F.col("url")
    hidden = r"(?is)<!--.*?(?:-->|$)|<(script|style|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|$)"
    shown = pages.where(url.isNotNull() & html.rlike(r"(?i)canonical|refresh")).select(url.alias("from_url"), F.regexp_replace(html, hidden, " ").alias("shown"))
    tags = F.filter(
        F.regexp_extract_all("shown", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"),
    )
    based = shown.withColumn("_tag", F.regexp_extract("shown", r"(?i)<base\b[^>]*>", 0)).withColumn("_href", F.when(F.col("_tag") != "", _decoded(_attribute(F.col("_tag"), "href"))))
    based = _resolved(based, "_href", "from_url", "_base").withColumn("base", F.when(F.col("_href") != "", F.col("_base")).otherwise(F.col("from_url")))
    declared = based.select("from_url", "base", F.explode(tags).alias("tag"))
    to = F.when(F.col("tag").rlike("(?i)^<link"), _attribute(F.col("tag"), "href")).otherwise(F.trim(F.regexp_extract(F.col("tag"), r"(?i)\burl\s*=\s*'?([^\"'>]+)", 1)))
    found = declared.withColumn("to", _decoded(to)).where(F.col("to") != "")
    return _resolved(found, "to", "base", "to_url").select("from_url", "to_url").where("from_url <> to_url")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Judge the url of every row of ``pages`` (page_id, url, html).

    Returns page_id, host, path, rule, verdict and ``via`` (rule, alias or default). A url's own rule decides
    first, so an explicit allow holds even among blocked aliases. A url without a rule is blocked if any url of
    its component is blocked by a rule; components join urls over canonical links, meta refreshes and the rows of
    ``redirects`` (from_url, to_url). All else gets ``default``.

    Null urls and urls without ``://`` have empty host and path, fit no rule and have no aliases. Repeated rows and
    ids give a row each; an empty table gives no rows; other columns of ``pages`` are not read. Only edges and the
    urls on them are shuffled; pages join the blocked urls' table, which holds urls that declare a link.
    """
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url").where("from_url is not null and to_url is not null"))
    links = materialize(links, "links")
    edges = links.where(F.col("to_url").contains("://")).select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b"))
    edges = materialize(edges.where("a <> b"), "aliases")
    named = edges.select(F.col("a").alias("alias_key")).union(edges.select("b")).distinct().withColumn("node", F.md5("alias_key"))
    reach = components(edges.select(F.md5("a").alias("u"), F.md5("b").alias("v")))
    judged = match_rules(with_parts(named, "alias_key"), rules, "node")
    placed = materialize(judged.join(reach, "node").select("alias_key", "component", "action"), "judged")
    release(links, edges, reach)
    bad = placed.where("action = 'block'").select("component").distinct()
    blocked = placed.where("action is null").join(bad, "component", "left_semi").select("alias_key").distinct()
    own = match_rules(with_parts(pages.select("page_id", "url"), "url").withColumn("row", F.monotonically_increasing_id()), rules, "row")
    out = own.withColumn("key", F.when(F.col("url").contains("://"), url_key(F.col("url")))).join(blocked, F.col("key") == F.col("alias_key"), "left")
    aliased = F.col("alias_key").isNotNull()
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(aliased, F.lit("block")), F.lit(default)).alias("verdict"),
        F.when(F.col("action").isNotNull(), F.lit("rule")).when(aliased, F.lit("alias")).otherwise(F.lit("default")).alias("via"),
    )
