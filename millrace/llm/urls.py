"""URL filter: explicit rules, and a tree of path templates per host (operator 4).

1. Urls are cut into host and path; equal ones are judged once.
2. Digits inside segments become `{n}`, long hexadecimal ones `{hex}`; what is
   left is grouped, so a host's pages are a few typed paths.
3. The tree is grown for all hosts together, from each node down to the first
   segment at which its paths part, as deep as they part.  Below each such
   node a child is generalised to `*` if the node has more than `branches`
   children and the child less than `least_share` of its pages (a variable
   segment), or if its share of bad labels does not differ from that of all its
   siblings together by more than `z` standard errors (a similar branch, merged
   with the others).
4. A template's share of bad labels is smoothed towards its host's, which is
   smoothed towards that of all pages.  Templates with a share of `reject` or
   more are blocked.
5. Of the rules that fit (host or parent domain, and start of the path) the
   longest decides; only urls without one are left to the templates.

Where all pages of a node have one and the same rest of the path, what of it
lies below `depth` is written `**`; that names a template but joins no two.

Defined results: a null url, or one without `://`, has empty host and path and
is judged like any other; labels that are null are not counted; a rule with an
empty host fits empty hosts only; of two rules of equal length the smaller
string decides, of equal rules `block`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), *LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def typed_segments(path: Column) -> Column:
    """Segments of a path with digits and hexadecimal strings generalised."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")

    def typed(s):
        bare = F.regexp_replace(s, "[0-9]+", "{n}")
        return F.when(F.rlike(s, F.lit("^(?=.*[0-9])[0-9a-fA-F-]{16,}$")), F.lit("{hex}")).otherwise(bare)

    return F.transform(parts, typed)


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path) distinct, rules (host, path, verdict) -> host, path, rule, rule_verdict where one fits."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    given = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).withColumn("rule", F.concat("rule_host", "rule_path"))
    met = urls.withColumn("suffix", F.explode(suffixes)).join(
        given, (F.col("suffix") == F.col("rule_host")) & F.startswith("path", F.col("rule_path"))
    )
    order = F.struct(-F.length("rule"), "rule", (F.col("rule_verdict") != "block").alias("open"))
    best = met.groupBy("host", "path").agg(F.min_by(F.struct("rule", "rule_verdict"), order).alias("r"))
    return best.select("host", "path", "r.rule", "r.rule_verdict")


def templates(
    paths: DataFrame, scratch: Scratch, depth: int, branches: int, least_share: float, z: float
) -> DataFrame:
    """paths (host, segments, n, labelled, bad) -> host, segments, template and the counts."""
    node, counts = ["host", "template"], ["n", "labelled", "bad"]
    now = paths.withColumn("template", F.lit("")).withColumn("at", F.lit(0))
    size = F.size("segments") - F.col("at")
    rest = F.slice("segments", F.col("at") + 1, F.greatest(size, F.lit(0)))
    done = []
    while not now.isEmpty():
        # paths part at the first segment in which one differs from the longest
        longest = scratch.write(now.groupBy(*node).agg(F.max_by(rest, size).alias("longest")), "longest")
        same = F.zip_with(rest, "longest", lambda x, y: x == y)
        marked = now.join(longest, node).withColumn("differs", F.array_position(same, False).cast("int"))
        marked = scratch.write(marked.drop("longest"), "marked")
        ends = marked.groupBy(*node).agg(
            F.min(F.when(F.col("differs") > 0, F.col("differs"))).alias("split"), (F.min(size) == F.max(size)).alias("equal")
        )
        placed = scratch.write(marked.drop("differs").join(scratch.write(ends, "ends"), node), "placed")

        on = F.col("split").isNotNull() & (size >= F.col("split"))
        single = F.col("split").isNull() & F.col("equal") & (F.size("segments") > depth)
        shown = F.when(single, F.concat(F.slice(rest, 1, F.greatest(depth - F.col("at"), F.lit(0))), F.array(F.lit("**"))))
        ended = placed.where(~on).withColumn("template", _below(F.coalesce(shown, rest)))
        done.append(scratch.write(ended.select(*node, "segments", *counts), "done"))

        now = placed.where(on).withColumn("child", F.get(rest, F.col("split") - 1))
        now = now.withColumn("template", _below(F.slice(rest, 1, F.col("split") - 1)))
        now = scratch.write(now.withColumn("at", F.col("at") + F.col("split")).drop("split", "equal"), "going")
        sums = [F.sum(c).alias(c) for c in counts]
        children = scratch.write(now.groupBy(*node, "child").agg(*sums), "children")
        nodes = children.groupBy(*node).agg(*[F.sum(c).alias(f"all_{c}") for c in counts], F.count("*").alias("width"))
        nodes = scratch.write(nodes, "nodes")
        share = F.col("all_bad") / F.greatest("all_labelled", F.lit(1))
        error = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))
        apart = F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - share) > z * error
        rare = (F.col("width") > branches) & (F.col("n") < least_share * F.col("all_n"))
        alike = (F.col("labelled") == 0) | ~apart
        merged = children.join(nodes, node).where(rare | alike)
        merged = scratch.write(merged.select(*node, "child", F.lit("*").alias("wild")), "merged")
        now = now.join(merged, [*node, "child"], "left")
        name = F.concat("template", F.lit("/"), F.coalesce("wild", "child"))
        now = scratch.write(now.withColumn("template", name).drop("child", "wild"), "level")
        done.append(now.where(size == 0).select(*node, "segments", *counts))
        now = now.where(size > 0)
        scratch.drop("longest", "marked", "ends", "placed", "going", "children", "nodes", "merged")
    return reduce(DataFrame.unionByName, done, paths.withColumn("template", F.lit("")).where("false"))


def _below(segments: Column) -> Column:
    """The template with more segments."""
    more = F.concat(F.lit("/"), F.array_join(segments, "/"))
    return F.concat("template", F.when(F.size(segments) > 0, more).otherwise(F.lit("")))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    bad_col: str = "bad",
    depth: int = 6,
    branches: int = 30,
    least_share: float = 0.02,
    z: float = 3.0,
    weight: float = 10.0,
    reject: float = 0.5,
) -> DataFrame:
    """Rows (id, host, path, rule, verdict, template, bad_share), one for each row of pages.

    `bad_col` is 1 for pages labelled as bad, 0 as good, null without a label."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), F.col(f"`{bad_col}`").alias("bad"))
    with Scratch(spark) as scratch:
        counts = [F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")]
        urls = scratch.write(rows.groupBy("host", "path").agg(*counts), "urls")
        typed = urls.withColumn("segments", typed_segments(F.col("path")))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        paths = scratch.write(typed.groupBy("host", "segments").agg(*sums), "paths")
        tree = templates(paths, scratch, depth, branches, least_share, z)
        found = scratch.write(tree.groupBy("host", "template").agg(*sums), "templates")

        every = found.agg(F.sum("bad"), F.sum("labelled")).first()
        overall = (every[0] or 0) / max(1, every[1] or 0)
        hosts = found.groupBy("host").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
        hosts = scratch.write(
            hosts.select("host", ((F.col("b") + weight * overall) / (F.col("l") + weight)).alias("usual")), "hosts"
        )
        share = (F.col("bad") + weight * F.col("usual")) / (F.col("labelled") + weight)
        shares = found.join(hosts, "host").select("host", "template", share.alias("bad_share"))
        named = tree.select("host", "segments", "template").join(shares, ["host", "template"])
        named = scratch.write(named, "named")
        ruled = scratch.write(longest_rules(urls.select("host", "path"), rules), "ruled")
        judged = typed.select("host", "path", "segments").join(named, ["host", "segments"]).drop("segments")
        judged = judged.join(ruled, ["host", "path"], "left")
        own = F.when(F.col("bad_share") >= reject, F.lit("block")).otherwise(F.lit("allow"))
        judged = scratch.result(judged.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict"))
    return rows.drop("bad").join(judged, ["host", "path"]).select(
        F.col("id").alias(id_col), "host", "path", "rule", "verdict", "template", "bad_share"
    )
