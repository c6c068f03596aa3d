"""URL filters by a path-template tree.

Per host, paths are cut into segments; variable segments (numbers, long or mixed identifiers) become wildcards. A
path's templates are all its prefixes, from the bare host down to the whole path. Labelled pages give each template its
numbers of good and bad pages. Siblings whose shares of bad pages lie above, within or below what chance allows around
their family's share are one branch each, and a template that does not differ from its branch by more than chance takes
the branch's numbers. A page is rejected when the deepest of its templates with evidence has a smoothed share of bad
pages above the limit; the smoothing pulls a template towards its parent, and a host towards all.

Built of DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import staged

#: Weight of the parent's share in a template's own, in pages.
PRIOR = 10.0
#: Smoothed share of bad pages above which a template is rejected.
LIMIT = 0.5
#: Shares that differ by at most so many standard errors are alike.
ERRORS = 2.0

# Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> F.Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = verdict = F.lit(None).cast("string")
    for said, name, start in reversed(longest):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def general(segment) -> F.Column:
    """A segment with its variable parts as wildcards: numbers, and identifiers that mix letters with digits."""
    marked = F.regexp_replace(segment, r"\p{L}*[0-9][\p{L}0-9_-]*", "*")
    return F.when(F.length(marked) > 40, F.lit("*")).otherwise(marked)


def templates(host, path) -> F.Column:
    """The templates of a path, bare host first: an array of (depth, template, parent)."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    marked = F.transform(parts, general)
    name = lambda d: F.concat_ws("/", host, F.slice(marked, 1, d))
    return F.transform(
        F.sequence(F.lit(0), F.size(marked)),
        lambda d: F.struct(
            d.alias("depth"),
            name(d).alias("template"),
            F.when(d > 0, name(F.greatest(d - 1, F.lit(0)))).alias("parent"),
        ),
    )


def alike(n, bad, n_all, bad_all) -> F.Column:
    """Whether a share differs from that of all by no more than chance; the larger it is, the less it may."""
    mean = bad_all / n_all
    error = F.sqrt((mean * (1 - mean) + F.lit(0.25) / n_all) / n)
    return F.coalesce(F.abs(bad / n - mean) <= ERRORS * error, F.lit(False))


def tree(labelled: DataFrame) -> DataFrame:
    """(template, depth, n, bad): the pages of every template seen in labelled pages, or those of its branch.

    `labelled` has host, path and bad (boolean). Counts are combined inside tasks, so a host with a third of all
    pages moves as one row per task and template.
    """
    steps = labelled.select(F.explode(templates(F.col("host"), F.col("path"))).alias("t"), F.col("bad").cast("int").alias("bad"))
    counts = steps.groupBy("t.depth", "t.template", "t.parent").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counts = staged(counts, "templates")
    inner = counts.where("parent is not null")
    sums = [F.sum("n").alias("n_all"), F.sum("bad").alias("bad_all")]
    own = (F.col("n"), F.col("bad"), F.col("n_all"), F.col("bad_all"))
    family = inner.groupBy("parent").agg(*sums)
    side = F.when(alike(*own), 0).when(F.col("bad") / F.col("n") > F.col("bad_all") / F.col("n_all"), 1).otherwise(-1)
    sided = inner.join(family, "parent").withColumn("side", side).drop("n_all", "bad_all")
    branches = sided.groupBy("parent", "side").agg(*sums)
    merged = sided.join(branches, ["parent", "side"]).select(
        "template", "depth",
        F.when(alike(*own), F.col("n_all")).otherwise(F.col("n")).alias("n"),
        F.when(alike(*own), F.col("bad_all")).otherwise(F.col("bad")).alias("bad"),
    )
    return merged.unionByName(counts.where("parent is null").select("template", "depth", "n", "bad"))


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict) for every page: the longest rule's verdict, else that of the template tree.

    `labelled` has columns url and bad (boolean; nulls are left out). A null url or one without :// has an empty host
    and path and fits no rule. A page none of whose templates is labelled is allowed. Repeated rows and ids get a row
    each; other columns are not read.
    """
    known = labelled.where(F.col("bad").isNotNull() & F.col("url").isNotNull())
    known = known.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "bad")
    known = staged(tree(known), "tree")
    hosts = known.where("depth = 0").agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("overall"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col), F.col(url).alias("url_")).select(
        F.col(id_col), host_of(F.col("url_")).alias("host"), path_of(F.col("url_")).alias("path")
    )
    rows = rows.withColumns({"rule": rule, "said": said})
    # Pages that share a deepest template share a verdict: templates are looked up once each, not once per page.
    chain = F.transform(templates(F.col("host"), F.col("path")), lambda t: t.template)
    rows = rows.withColumn("leaf", F.element_at(chain, -1))
    leaves = rows.where("said is null").select("leaf", F.posexplode(chain).alias("depth", "template")).distinct()
    # A labelled template's parents are labelled too: the numbers from the host down to the deepest known template.
    steps = leaves.drop("depth").join(known, "template").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "n", "bad"))).alias("steps"))
    share = F.aggregate("steps", F.col("overall"), lambda above, t: (t.bad + PRIOR * above) / (t.n + PRIOR))
    found = steps.withColumn("overall", hosts.scalar()).select("leaf", share.alias("share"))
    bad = found.where(F.col("share") > LIMIT).select("leaf", F.lit("block").alias("learned"))
    return rows.join(bad, "leaf", "left").select(
        id_col, "host", "path", "rule", F.coalesce("said", "learned", F.lit("allow")).alias("verdict")
    )
