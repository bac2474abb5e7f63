"""URL verdicts by rules and, where no rule fits, by a path-template tree for each host.

A path's segments are generalised at once: runs of digits and long hexadecimal words become wildcards. Then the tree of
a host grows level by level. Labels are the verdicts of the rules. A branch whose blocked share differs significantly
from that of its siblings together gets a template of its own; labelled branches that don't differ are merged into
`*`, and unlabelled ones into `?`, which knows no more than its parent. A template ends where no branch below it could
differ: where its labels agree or are too few. A template's purity is its blocked share, smoothed by that of the other
labels of its parent, theirs by those around them, up to the whole table's; each label counts once. A template whose
purity reaches the threshold is rejected. All of it runs on counts by (host, generalised path), never on groups of
URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.sources.shared import materialise

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Least URLs of a branch with a template of its own; deviation, in sigmas, that tells it from its siblings; weight of
#: what is around a template's own labels; purity without any label; purity that rejects.
SUPPORT, DEVIATION, PRIOR, EVEN, REJECT = 5, 3.0, 4.0, 0.5, 0.5
#: With so many labels at most no branch can deviate: a perfect split of l labels, k of them in the branch, lies k / sqrt(k * k / l)
#: = sqrt(l) sigmas off.
FEW = int(DEVIATION**2)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    """The generalised path: segments of 8 and more hexadecimal digits and dashes, with a letter and a digit, become
    {h}; in all others runs of digits become {n}."""
    hexadecimal = lambda x: x.rlike("^[0-9a-f-]{8,}$") & x.rlike("[a-f]") & x.rlike("[0-9]")
    return F.array_join(F.transform(F.split(path, "/"), lambda x: F.when(hexadecimal(x), "{h}").otherwise(F.regexp_replace(x, "[0-9]+", "{n}"))), "/")


def smoothed(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + PRIOR * prior) / (labelled + PRIOR)


def is_open(labelled: Column, blocked: Column, urls: Column) -> Column:
    """Whether a branch below could still deviate."""
    return (labelled > FEW) & (blocked > 0) & (blocked < labelled) & (urls >= SUPPORT)


def templates(counts: DataFrame) -> DataFrame:
    """host, shape, template and purity from host, shape, n (URLs), l (labelled), b (blocked).

    A round for each level of the paths as long as some template is open; what has ended leaves the rounds.
    """
    total = counts.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("tl"), F.coalesce(F.sum("b"), F.lit(0)).alias("tb"))  # one row
    top = counts.groupBy("host").agg(*[F.sum(c).alias(f"s{c}") for c in "nlb"]).crossJoin(F.broadcast(total))
    top = top.withColumn("prior", smoothed(F.col("tb") - F.col("sb"), F.col("tl") - F.col("sl"), F.lit(EVEN)))
    top = top.select("host", F.lit("").alias("template"), "prior", smoothed(F.col("sb"), F.col("sl"), F.col("prior")).alias("purity"), is_open(F.col("sl"), F.col("sb"), F.col("sn")).alias("open"))
    keep = ["host", "shape", "n", "l", "b", "template", "prior", "purity", "open"]
    state = materialise(counts.join(top, "host").select(keep), "shapes")
    done, level = [state.where("NOT open")], 0
    while not (here := state.where("open")).isEmpty():
        level += 1
        here = here.withColumn("seg", F.try_element_at(F.split("shape", "/"), F.lit(level + 1)))
        done.append(here.where("seg IS NULL").drop("seg"))
        node = here.groupBy("host", "template").agg(F.sum("l").alias("nl"), F.sum("b").alias("nb"), F.max("prior").alias("prior"))
        branch = here.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(*[F.sum(c).alias(f"s{c}") for c in "nlb"]).join(node, ["host", "template"])
        rest = F.greatest(F.col("nl") - F.col("sl"), F.lit(1))
        share, others = F.col("nb") / F.col("nl"), (F.col("nb") - F.col("sb")) / rest
        sigma = F.sqrt(share * (1 - share) * F.col("sl") * (1 + F.col("sl") / rest))
        own = (F.col("sn") >= SUPPORT) & (F.col("sl") < F.col("nl")) & (F.abs(F.col("sb") - F.col("sl") * others) > DEVIATION * sigma)
        name = F.when(F.col("sl") == 0, "?").when(own, F.col("seg")).otherwise("*")
        # a segment that is itself ? or * can't be taken for the merged ones
        name = F.when((F.col("sl") > 0) & own & F.col("seg").isin("?", "*"), F.concat(F.lit("="), "seg")).otherwise(name)
        branch = materialise(branch.withColumn("next", F.concat("template", F.lit("/"), name)), "branches")
        made = branch.groupBy("host", "template", "next").agg(*[F.sum(f"s{c}").alias(f"g{c}") for c in "nlb"], *[F.max(c).alias(c) for c in ("nl", "nb", "prior")])
        made = made.withColumn("prior", smoothed(F.col("nb") - F.col("gb"), F.col("nl") - F.col("gl"), F.col("prior")))
        made = made.select("host", "template", "next", "prior", smoothed(F.col("gb"), F.col("gl"), F.col("prior")).alias("purity"), is_open(F.col("gl"), F.col("gb"), F.col("gn")).alias("open"))
        step = branch.select("host", "template", "seg", "next").join(made, ["host", "template", "next"])
        state = here.where("seg IS NOT NULL").drop("prior", "purity", "open").join(step, ["host", "template", "seg"]).withColumn("template", F.col("next"))
        state = materialise(state.select(keep), "shapes")
        done.append(state.where("NOT open"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("host", "shape", "template", "purity")


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages (page_id, url).

    Null urls and those without :// have empty host and path; they are judged like any other. The longest rule that
    fits a host or its domain and the start of the path decides (the verdict that sorts last, if two are equal), the
    template's purity else. Repeated rows, and null ids, stay and count. URLs are read whole, however long. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"), shape_of(F.col("path")).alias("shape"))
    counts = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("r").alias("l"), F.sum((F.col("r.verdict") == "block").cast("long")).alias("b"))
    counts = materialise(counts.select("host", "shape", "n", "l", F.coalesce("b", F.lit(0).cast("long")).alias("b")), "counts")
    found = rows.join(templates(counts), ["host", "shape"])
    verdict = F.coalesce("r.verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def oracle() -> str:
    """judge() in DuckDB SQL."""
    rules = "NULL"
    for verdict, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r)):
        rules = f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{verdict}' ELSE {rules} END"
    open_ = lambda g: f"({g}l > {FEW} AND {g}b > 0 AND {g}b < {g}l AND {g}n >= {SUPPORT})"
    pure = lambda b, l, prior: f"(({b}) + {PRIOR} * {prior}) / (({l}) + {PRIOR})"  # noqa: E741, E731
    return f"""WITH RECURSIVE
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
w AS (SELECT *, array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9a-f-]{{8,}}') AND regexp_matches(s, '[a-f]') AND regexp_matches(s, '[0-9]') THEN '{{h}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END), '/') AS shape, {rules} AS r FROM u),
c AS (SELECT host, shape, count(*) AS n, count(r) AS l, count(*) FILTER (r LIKE '%|block') AS b FROM w GROUP BY host, shape),
h AS (SELECT *, sum(n) OVER x AS sn, sum(l) OVER x AS sl, sum(b) OVER x AS sb, sum(l) OVER () AS tl, sum(b) OVER () AS tb FROM c WINDOW x AS (PARTITION BY host)),
p AS (SELECT *, {pure("tb - sb", "tl - sl", EVEN)} AS prior FROM h),
t AS (SELECT 0 AS level, host, shape, n, l, b, '' AS template, prior::DOUBLE AS prior, ({pure("sb", "sl", "prior")})::DOUBLE AS purity, {open_("s")} AS open, FALSE AS ended FROM p
UNION ALL
SELECT level, host, shape, n, l, b, next, CASE WHEN seg IS NULL THEN prior ELSE prior2 END, (CASE WHEN seg IS NULL THEN purity ELSE {pure("gb", "gl", "prior2")} END)::DOUBLE, seg IS NOT NULL AND {open_("g")}, seg IS NULL
FROM (SELECT *, ({pure("nb - gb", "nl - gl", "prior")})::DOUBLE AS prior2 FROM
(SELECT *, sum(n) OVER y AS gn, sum(l) OVER y AS gl, sum(b) OVER y AS gb FROM
(SELECT *, CASE WHEN seg IS NULL THEN template WHEN sl = 0 THEN template || '/?' WHEN own AND seg IN ('?', '*') THEN template || '/=' || seg WHEN own THEN template || '/' || seg ELSE template || '/*' END AS next FROM
(SELECT *, sn >= {SUPPORT} AND sl < nl AND abs(sb - sl * ((nb - sb) / greatest(nl - sl, 1))) > {DEVIATION} * sqrt((nb / nl) * (1 - nb / nl) * sl * (1 + sl / greatest(nl - sl, 1))) AS own FROM
(SELECT *, sum(n) OVER z AS sn, sum(l) OVER z AS sl, sum(b) OVER z AS sb, sum(l) OVER v AS nl, sum(b) OVER v AS nb FROM
(SELECT level + 1 AS level, host, shape, n, l, b, template, prior, purity, string_split(shape, '/')[level + 2] AS seg FROM t WHERE open)
WINDOW v AS (PARTITION BY host, template), z AS (PARTITION BY host, template, seg))))
WINDOW y AS (PARTITION BY host, next, seg IS NULL))))
SELECT page_id, host, path, string_split(r, '|')[1] AS rule, coalesce(string_split(r, '|')[2], CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM w JOIN t USING (host, shape) WHERE NOT open"""
