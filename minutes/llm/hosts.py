"""URL filters: rules by host and path, and for all other pages the reputation of their host.

Reputation is an empirical-Bayes estimate over three levels. A level's prior is beta-binomial around the mean of the
level above (all pages, public suffix, registered domain, host); how strong it is follows from how much the groups of
that level differ beyond chance (a method of moments). A page is blocked if the upper bound of its host's posterior
share of good pages lies below a threshold, so a host needs bad outcomes, its own or its domain's, to be blocked.

For reputation a host goes without user and port. The public suffix is the longest of ``suffixes`` that it ends with,
else its last label; the registered domain has one label more. A numeric address is a domain of its own, and all of
them share a suffix.

Defined cases: a null url or one without :// has an empty host and path and is judged as a host of its own; labels
that are null, or of no page, do not count, and every label of a page counts as an outcome; rows that repeat an id are
judged row by row, and each counts with the page's labels; a null page_id has no labels; without any label every host
stands at one half and is allowed; urls of any length are read whole; an empty table gives no rows. Only the id and the
url column are read, under names of their own, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Common public suffixes of two labels. A deployment passes the list it keeps, of any number of labels.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw",
    "com.ua", "com.ve", "com.vn", "edu.au", "edu.cn", "go.jp", "go.kr", "gob.ar", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ltd.uk",
    "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "plc.uk",
)
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$"
#: Limits of a prior's strength in pages, the normal quantile of the bound, and the least share of good pages.
WEAKEST, STRONGEST, QUANTILE, LEAST_GOOD = 1.0, 1000.0, 1.645, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host/path) that fits, and its verdict; nulls if none does."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + tail)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(said))
    return rule, verdict


def name_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    out = F.when(name.rlike(ADDRESS), "")
    for n in sorted({s.count(".") + 1 for s in suffixes}, reverse=True):
        tail = F.substring_index(name, ".", -n)
        out = out.when(tail.isin([s for s in suffixes if s.count(".") + 1 == n]), tail)
    return out.otherwise(F.substring_index(name, ".", -1))


def domain(name: Column, of: Column) -> Column:
    """The registered domain: the suffix and one label before it."""
    labels = F.size(F.split(of, r"\.")) + 1
    return F.when(of == "", name).otherwise(F.array_join(F.slice(F.split(name, r"\."), -F.least(labels, F.size(F.split(name, r"\."))), labels), "."))


def strength(groups: DataFrame, s: str, n: str, mean: str) -> float:
    """The strength of a level's prior: with r the correlation of pages in a group, n (p - m)^2 / (m (1 - m)) has the
    mean 1 + (n - 1) r; a prior of strength 1 / r - 1 has that correlation."""
    p, m = F.col(s) / F.col(n), F.col(mean)
    spread = F.col(n) * (p - m) * (p - m) / (m * (1 - m))
    q, k, pairs = groups.where(F.col(n) > 0).where((m > 0) & (m < 1)).agg(F.coalesce(F.sum(spread), F.lit(0.0)), F.count("*"), F.coalesce(F.sum(F.col(n) - 1), F.lit(0))).first()
    r = (q - k) / pairs if pairs else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / r - 1 if r > 0 else STRONGEST))


def reputation(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, good_upper) from (host, good, labelled), names without user and port: counts of good and of all labelled pages."""
    base = hosts.withColumn("suffix", suffix(F.col("host"), suffixes))
    base = stored(base.withColumn("domain", domain(F.col("host"), F.col("suffix"))), "hosts")
    good, labelled = base.agg(F.sum("good"), F.sum("labelled")).first()
    mean = good / labelled if labelled else 0.5
    levels = base
    parent = F.lit(mean)
    for level in ("suffix", "domain"):
        sums = base.groupBy(*dict.fromkeys(("suffix", level))).agg(F.sum("good").alias("g"), F.sum("labelled").alias("n"))
        if level == "domain":
            sums = sums.join(above, "suffix")  # noqa: F821
            parent = F.col("mean_suffix")
        sums = sums.withColumn("parent", parent)
        k = strength(sums, "g", "n", "parent")
        above = sums.select(level, ((F.col("g") + k * F.col("parent")) / (F.col("n") + k)).alias(f"mean_{level}"))
    levels = base.join(above, "domain")
    k = strength(levels, "good", "labelled", "mean_domain")
    a, b = F.col("good") + k * F.col("mean_domain"), F.col("labelled") - F.col("good") + k * (1 - F.col("mean_domain"))
    upper = a / (a + b) + QUANTILE * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return levels.select("host", upper.alias("good_upper"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict) for every page."""
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), name_of(host).alias("name"))
    outcome = labels.select(F.col(label_id).alias("page_id"), F.col(label_col).alias("label")).dropna()
    by_page = outcome.groupBy("page_id").agg(F.sum((F.col("label") == 1).cast("long")).alias("good"), F.count("*").alias("labelled"))
    zero = F.lit(0).cast("long")
    counts = own.select("page_id", F.col("name").alias("host")).join(by_page, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("good"), zero).alias("good"), F.coalesce(F.sum("labelled"), zero).alias("labelled"))
    known = reputation(counts, suffixes).withColumnRenamed("host", "name")
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    judged = own.join(known, "name", "left")
    method = F.when(F.col("good_upper") < LEAST_GOOD, "block").otherwise("allow")
    return judged.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"))


def sql(pages: str, labels: str, rules: list[tuple[str, str]], suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """The same in SQL, for tables with the default names and suffixes of two labels."""
    last = lambda n: f"array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
    known = ", ".join(f"'{s}'" for s in suffixes)
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fits(text: str) -> str:
        name, slash, tail = text.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + tail}')"

    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ordered)
    said = " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in ordered)
    strength = (
        lambda table, g, n, m: f"""(SELECT CASE WHEN pairs = 0 OR q <= k THEN {STRONGEST} ELSE least({STRONGEST}, greatest({WEAKEST}, pairs / (q - k) - 1)) END FROM
        (SELECT coalesce(sum({n} * pow(({g} * 1.0 / {n}) - {m}, 2) / ({m} * (1 - {m}))), 0) q, count(*) k, coalesce(sum({n} - 1), 0)::DOUBLE pairs FROM {table} WHERE {n} > 0 AND {m} > 0 AND {m} < 1))"""
    )
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM {pages}),
    own AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM cut),
    bare AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') name FROM own),
    outcome AS (SELECT doc_id page_id, sum((quality = 1)::INT)::DOUBLE good, count(*)::DOUBLE labelled FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
    hosts AS (SELECT name host, coalesce(sum(good), 0) good, coalesce(sum(labelled), 0) labelled FROM bare LEFT JOIN outcome USING (page_id) GROUP BY 1),
    cut_hosts AS (SELECT *, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN '' WHEN {last(2)} IN ({known}) THEN {last(2)} ELSE {last(1)} END suffix FROM hosts),
    named AS (SELECT *, CASE WHEN suffix = '' THEN host WHEN contains(suffix, '.') THEN {last(3)} ELSE {last(2)} END domain FROM cut_hosts),
    whole AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good) / sum(labelled) ELSE 0.5 END mean FROM named),
    suffixes AS (SELECT suffix, sum(good) g, sum(labelled) n, (SELECT mean FROM whole) parent FROM named GROUP BY 1),
    s AS (SELECT suffix, (g + k * parent) / (n + k) mean FROM suffixes, (SELECT {strength("suffixes", "g", "n", "parent")} k)),
    domains AS (SELECT domain, g, n, s.mean parent FROM (SELECT domain, suffix, sum(good) g, sum(labelled) n FROM named GROUP BY 1, 2) JOIN s USING (suffix)),
    d AS (SELECT domain, (g + k * parent) / (n + k) mean FROM domains, (SELECT {strength("domains", "g", "n", "parent")} k)),
    h AS (SELECT host, good, labelled, d.mean m FROM named JOIN d USING (domain)),
    post AS (SELECT host, good + k * m a, labelled - good + k * (1 - m) b FROM h, (SELECT {strength("h", "good", "labelled", "m")} k)),
    bound AS (SELECT host, a / (a + b) + {QUANTILE} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) top FROM post)
    SELECT page_id, own.host, path, CASE {rule} END AS rule, CASE {said} WHEN top < {LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict
    FROM bare own LEFT JOIN (SELECT host AS bound_host, top FROM bound) ON own.name = bound_host
    """
