"""URL filtering by a tree of path templates (operator 7), by DataFrame functions only.

Every host has a tree over the segments of its paths. It is worked out level by level from the top, at each node over
the different segments that follow there (its children):

* of a node with more than `fan` different children, those with under a `fan`th of its pages are variable: one wildcard;
* the other children are merged into one branch where they are statistically alike: what follows a child (the shapes of
  the next segments, by pages) has a cosine similarity of at least `alike` with what follows the node's other children,
  and its labelled share of blocked pages differs from theirs in the same direction, or by no more than `z_bound`
  (two-proportion score).

A path through the final tree is a template. Templates are rejected if their labelled purity, smoothed towards the
host's share and that towards the whole table's, is over `reject`.

Branches with one path are settled: nothing below them can be generalised or merged. So the work ends at the deepest
level at which paths part, and the rows that are left shrink from level to level. A level is a few group-bys of the
different (host, path) pairs and joins with their results, which are stored, so that a host or segment with a large part
of the rows is split by Spark's skew handling.

Rules come first: the longest rule that fits decides a page. Pages that a rule decides are the labels.

Defined results: a url that is null or lacks `://` has empty host and path; hosts without labels fall back on
the whole table's share; an empty table gives an empty result; repeated rows count each time; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut, drop_cut

FAN, STRENGTH, REJECT, Z_BOUND, ALIKE = 64, 10.0, 0.8, 3.0, 0.9


def located(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host (A-Z lower-cased), path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))


def decided(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls with rule and verdict of the longest rule that fits, both null if none does. rules: (verdict, `host/path`)."""
    out_rule: Column = F.lit(None).cast("string")
    out_verdict: Column = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out_rule = F.when(fits, F.lit(rule)).otherwise(out_rule)
        out_verdict = F.when(fits, F.lit(verdict)).otherwise(out_verdict)
    return urls.withColumn("rule", out_rule).withColumn("verdict", out_verdict)


def segments(path: str = "path") -> Column:
    """The path's segments, without the first slash."""
    return F.split(F.regexp_replace(path, "^/", ""), "/", -1)


def shape(segment: Column) -> Column:
    """Runs of digits as 0, runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(segment, "[A-Za-z]+", "a"), "[0-9]+", "0")


def _level(tree: DataFrame, fan: int, z_bound: float, alike: float) -> DataFrame:
    """host, above, seg, name: what each child (seg) of a node (host, above) is called in the templates. tree: host, above
    (the template so far), rest (segments that are left), n, lab, bad."""
    node, child = ["host", "above"], ["host", "above", "seg"]
    rows = tree.select(*node, F.get("rest", F.lit(0)).alias("seg"), F.when(F.size("rest") > 1, shape(F.get("rest", F.lit(1)))).otherwise("$").alias("after"), "n", "lab", "bad")
    follows = cut(rows.groupBy(*child, "after").agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad")))
    below = follows.groupBy(*node, "after").agg(F.sum("n").alias("whole"))
    squares = below.groupBy(*node).agg(F.sum(F.col("whole").cast("double") * F.col("whole")).alias("vv"))
    own = follows.join(below, [*node, "after"]).groupBy(*child).agg(
        F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("cc"), F.sum(F.col("n").cast("double") * F.col("whole")).alias("cv"),
    )
    own = cut(own)
    sums = own.groupBy(*node).agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all_n"), F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
    totals = cut(sums.join(squares, node))
    both = own.join(totals, node)
    variable = (F.col("kids") > fan) & (F.col("n") * fan < F.col("all_n"))
    # the child against the node's other children
    dot, rest = F.col("cv") - F.col("cc"), F.col("vv") - 2 * F.col("cv") + F.col("cc")
    like = (dot > 0) & (dot * dot >= alike * alike * F.col("cc") * rest)
    p = F.col("all_bad") / F.col("all_lab")
    lab2, bad2 = F.col("all_lab") - F.col("lab"), F.col("all_bad") - F.col("bad")
    known = (F.col("lab") > 0) & (lab2 > 0) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_lab"))
    z = F.when(known, (F.try_divide(F.col("bad"), F.col("lab")) - F.try_divide(bad2, lab2)) / F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("lab")) + F.try_divide(F.lit(1.0), lab2))))
    side = F.when(z > z_bound, "+").when(z < -z_bound, "-").otherwise("=")
    literal = F.when(F.col("seg").startswith("<"), F.concat(F.lit("<"), F.col("seg"))).otherwise(F.col("seg"))
    # stored like the totals, so that the join isn't bound to the nodes' partitions and a node with most rows is split
    marked = cut(both.select(*child, literal.alias("literal"), F.when(variable, "*").when(like, side).alias("side")))
    # of merged branches there are at most `fan` at a node; variable and single ones need no list
    names = marked.filter("side <> '*'").groupBy(*node, "side").agg(F.sort_array(F.collect_set("literal")).alias("names"))
    joined = F.concat(F.lit("<"), F.array_join("names", "|"), F.lit(">"))
    named = marked.join(names.withColumn("merged", F.when(F.size("names") > 1, joined)).drop("names"), [*node, "side"], "left")
    out = cut(named.select(*child, F.when(F.col("side") == "*", "<*>").otherwise(F.coalesce("merged", "literal")).alias("name")))
    for used in (follows, own, totals, marked):
        drop_cut(used)
    return out


def templates(labelled: DataFrame, fan: int = FAN, strength: float = STRENGTH, z_bound: float = Z_BOUND, alike: float = ALIKE) -> DataFrame:
    """host, form (segments joined by /), template, share (smoothed blocked share) from rows of host, segs, blocked (1, 0, null)."""
    tree = labelled.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("lab"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    tree = cut(tree.select("host", F.array_join("segs", "/").alias("form"), F.lit("").alias("above"), F.col("segs").alias("rest"), "n", "lab", "bad"))
    done = []
    while True:
        size = tree.groupBy("host", "above").agg(F.count(F.lit(1)).alias("paths"))
        placed = tree.join(size, ["host", "above"])
        open_ = (F.col("paths") > 1) & (F.size("rest") > 0)
        left = F.transform("rest", lambda x: F.concat(F.lit("/"), F.when(x.startswith("<"), F.concat(F.lit("<"), x)).otherwise(x)))
        stays = placed.filter(~open_).select("host", "form", F.concat("above", F.array_join(left, "")).alias("template"), "lab", "bad")
        done.append(cut(stays))
        going = cut(placed.filter(open_).drop("paths"))
        if going.isEmpty():
            break
        names = _level(going, fan, z_bound, alike)
        keyed = going.withColumn("seg", F.get("rest", F.lit(0))).join(names, ["host", "above", "seg"])
        tree = cut(keyed.select("host", "form", F.concat("above", F.lit("/"), "name").alias("above"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), "n", "lab", "bad"))
        drop_cut(going)
        drop_cut(names)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    sums = found.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    hosts = sums.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    whole = hosts.agg(((F.coalesce(F.sum("h_bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("h_lab"), F.lit(0)) + 2)).alias("w")).first().w
    shares = sums.join(hosts, "host").withColumn("h", (F.col("h_bad") + F.lit(strength * whole)) / (F.col("h_lab") + F.lit(strength)))
    shares = shares.select("host", "template", ((F.col("bad") + strength * F.col("h")) / (F.col("lab") + strength)).alias("share"))
    return found.join(shares, ["host", "template"]).select("host", "form", "template", "share")


def judge(pages: DataFrame, rules: list[tuple[str, str]], reject: float = REJECT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), template, share of every row."""
    urls = decided(located(pages, id_col, url_col), rules).withColumn("segs", segments())
    labelled = urls.select("host", "segs", F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0).alias("blocked"))
    found = cut(templates(labelled))
    rows = urls.withColumn("form", F.array_join("segs", "/"))
    by_tree = F.when(F.col("share") > reject, "block").otherwise("allow")
    return rows.join(found, ["host", "form"]).select("page_id", "host", "path", "rule", F.coalesce("verdict", by_tree).alias("verdict"), "template", F.round("share", 9).alias("share"))


def judge_sql(rules: list[tuple[str, str]], levels: int = 6) -> str:
    """The same in DuckDB's SQL over `pages`, for tables whose paths part within the first `levels` segments."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    fits = lambda r: f"(host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered) + " END"
    escaped = "CASE WHEN starts_with({0}, '<') THEN '<' || {0} ELSE {0} END"
    steps = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
l AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT *, {rule} AS rule FROM l),
p AS (SELECT *, {verdict} AS verdict, string_split(regexp_replace(path, '^/', ''), '/') AS segs FROM r),
q0 AS (SELECT host, array_to_string(segs, '/') AS form, '' AS above, segs AS rest, count(*) AS n, count(verdict) AS lab, count(*) FILTER (WHERE verdict = 'block') AS bad FROM p GROUP BY host, segs)"""
    for s in range(levels):
        steps += f""",
f{s} AS (SELECT host, above, rest[1] AS seg, CASE WHEN len(rest) > 1 THEN regexp_replace(regexp_replace(rest[2], '[A-Za-z]+', 'a', 'g'), '[0-9]+', '0', 'g') ELSE '$' END AS after, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM q{s} WHERE len(rest) > 0 GROUP BY ALL),
w{s} AS (SELECT host, above, after, sum(n) AS whole FROM f{s} GROUP BY ALL),
v{s} AS (SELECT host, above, sum(whole::DOUBLE * whole) AS vv FROM w{s} GROUP BY ALL),
c{s} AS (SELECT host, above, seg, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad, sum(n::DOUBLE * n) AS cc, sum(n::DOUBLE * whole) AS cv FROM f{s} JOIN w{s} USING (host, above, after) GROUP BY ALL),
b{s} AS (SELECT c{s}.*, vv, count(*) OVER w AS kids, sum(n) OVER w AS all_n, sum(lab) OVER w AS all_lab, sum(bad) OVER w AS all_bad FROM c{s} JOIN v{s} USING (host, above) WINDOW w AS (PARTITION BY host, above)),
z{s} AS (SELECT *, CASE WHEN lab > 0 AND all_lab > lab AND all_bad > 0 AND all_bad < all_lab THEN (bad / lab - (all_bad - bad) / (all_lab - lab)) / sqrt(all_bad / all_lab * (1 - all_bad / all_lab) * (1.0::DOUBLE / lab + 1.0::DOUBLE / (all_lab - lab))) END AS z FROM b{s}),
k{s} AS (SELECT host, above, seg, {escaped.format('seg')} AS literal, CASE WHEN kids > {FAN} AND n * {FAN} < all_n THEN '*' WHEN cv - cc > 0 AND (cv - cc) * (cv - cc) >= {ALIKE * ALIKE!r}::DOUBLE * cc * (vv - 2 * cv + cc) THEN CASE WHEN z > {Z_BOUND} THEN '+' WHEN z < -{Z_BOUND} THEN '-' ELSE '=' END END AS side FROM z{s}),
m{s} AS (SELECT host, above, side, list_sort(list(DISTINCT literal)) AS names FROM k{s} WHERE side <> '*' GROUP BY ALL),
t{s} AS (SELECT k{s}.host, k{s}.above, seg, CASE WHEN k{s}.side = '*' THEN '<*>' WHEN len(names) > 1 THEN '<' || array_to_string(names, '|') || '>' ELSE literal END AS name FROM k{s} LEFT JOIN m{s} ON k{s}.host = m{s}.host AND k{s}.above = m{s}.above AND k{s}.side = m{s}.side),
q{s + 1} AS (SELECT q{s}.host, form, CASE WHEN len(rest) > 0 THEN q{s}.above || '/' || name ELSE q{s}.above END AS above, rest[2:] AS rest, n, lab, bad FROM q{s} LEFT JOIN t{s} ON q{s}.host = t{s}.host AND q{s}.above = t{s}.above AND rest[1] = seg)"""
    return steps + f""",
y AS (SELECT host, form, above || array_to_string(list_transform(rest, lambda x: '/' || {escaped.format('x')}), '') AS template, lab, bad FROM q{levels}),
g AS (SELECT host, template, sum(lab) AS lab, sum(bad) AS bad FROM y GROUP BY ALL),
h AS (SELECT host, sum(lab) AS h_lab, sum(bad) AS h_bad FROM g GROUP BY host),
w AS (SELECT (sum(h_bad) + 1) / (sum(h_lab) + 2) AS w FROM h),
x AS (SELECT host, template, (bad + {STRENGTH} * ((h_bad + {STRENGTH} * w) / (h_lab + {STRENGTH}))) / (lab + {STRENGTH}) AS share FROM g JOIN h USING (host), w)
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN share > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, y.template, round(share::DOUBLE, 9) AS share
FROM p JOIN y ON p.host = y.host AND array_to_string(p.segs, '/') = y.form JOIN x ON x.host = y.host AND x.template = y.template"""
