"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.llm import abuse, linkage, mixing, survivor, tokens, variants
from marlstone.operators.intervals import ymd
from marlstone.plans.registry import Registry
from marlstone.session import table, written

R = Registry()


@R.add(
    "p3_found",
    """
    WITH h AS (SELECT t.*, f.trust_rank, upper(substr(regexp_replace(cusip8, '\\s+', '', 'g'), 1, 8)) AS c8,
        last_day(CAST(date_trunc('quarter', rdate) AS DATE) + INTERVAL 2 MONTH) AS rq,
        CASE WHEN fdate >= rdate THEN date_diff('day', rdate, fdate) END AS delay
        FROM tfn_holdings t LEFT JOIN feeds f ON f.feed = t.feed WHERE rdate IS NOT NULL AND wficn IS NOT NULL AND cusip8 IS NOT NULL),
    g AS (SELECT wficn, rq, c8 FROM h GROUP BY ALL HAVING count(*) >= 2),
    s AS (SELECT *, row_number() OVER (PARTITION BY wficn, rq, c8 ORDER BY delay NULLS LAST, trust_rank NULLS LAST, hold_id) AS rn FROM h WHERE shares > 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY wficn, rq, c8 ORDER BY delay NULLS LAST, trust_rank NULLS LAST, hold_id) AS rn FROM h
          WHERE trim(ticker) NOT IN ('', 'N/A', '-'))
    SELECT g.wficn, CAST(strftime(g.rq, '%Y%m%d') AS INTEGER) AS rqdate, g.c8 AS cusip8, s.shares, t.ticker FROM g
    LEFT JOIN s ON s.rn = 1 AND s.wficn = g.wficn AND s.rq = g.rq AND s.c8 = g.c8
    LEFT JOIN t ON t.rn = 1 AND t.wficn = g.wficn AND t.rq = g.rq AND t.c8 = g.c8
    """,
)
def p3_found(spark, sf_dir):
    got = survivor.positions(table(spark, sf_dir, "tfn_holdings"), table(spark, sf_dir, "feeds"))
    return got.select("wficn", ymd("rq").alias("rqdate"), "cusip8", "shares", "ticker")


@R.add("p7_ids")
def p7_ids(spark, sf_dir):
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def _counted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", mixing.plain_source("source")).withColumn("lang", mixing.plain_language("lang"))
    return written(tokens.token_counts(docs, ["doc_id", "source", "lang"]), "p8-counts")


#: The sources of each domain of these tables: the upper level of the tree.
DOMAINS = {
    "filings": ["def14a", "s1_bios"],
    "votes": ["npx_rationale", "policy_notes"],
    "investors": ["letters_13f", "holder_comments"],
    "informal": ["forum_posts", "run_notes"],
}


@R.add("p8_mixture")
def p8_mixture(spark, sf_dir):
    return mixing.mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"), domains=DOMAINS)


@R.add("p8_shares")
def p8_shares(spark, sf_dir):
    counts, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(counts, targets, domains=DOMAINS), counts, targets)


@R.add("p8_short_shares")
def p8_short_shares(spark, sf_dir):
    """Shares of a mixture as large as the documents: sources too small for their share leave it to siblings, then to other domains."""
    counts, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(counts, targets, domains=DOMAINS, all_held=True), counts, targets)


@R.add("p8_short_mixture")
def p8_short_mixture(spark, sf_dir):
    return mixing.mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"), domains=DOMAINS, all_held=True)


def _fill(parent: str, child: str, into: str, by: str) -> str:
    """SQL that spreads ``parent.budget`` over its children by weight, none over its capacity: the fullest first, the rest shares what is left."""
    return f"""
    {into}_r AS (SELECT c.*, p.budget AS amount, c.capacity / c.weight AS full_at, row_number() OVER (PARTITION BY {by} ORDER BY c.capacity / c.weight, c.name) AS pos,
        coalesce(sum(c.capacity) OVER w, 0) AS taken, sum(c.weight) OVER (PARTITION BY {by}) - coalesce(sum(c.weight) OVER w, 0) AS weight_left
        FROM {child} c JOIN {parent} p USING ({by}) WHERE c.weight > 0
        WINDOW w AS (PARTITION BY {by} ORDER BY c.capacity / c.weight, c.name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {into}_l AS (SELECT *, (amount - taken) / weight_left AS level FROM {into}_r),
    {into}_f AS (SELECT *, coalesce(arg_min(level, pos) FILTER (WHERE full_at > level) OVER (PARTITION BY {by}), 1e300) AS cut FROM {into}_l),
    {into} AS (SELECT *, least(capacity, weight * cut) AS budget FROM {into}_f)"""


@R.add(
    "p8_budgets",
    r"""
    WITH d AS (SELECT replace(lower(trim(source, E' 	

')), '-', '_') AS source,
        CASE WHEN regexp_extract(lower(trim(lang)), '^([a-z]{2,3})(?:[-_].*)?$', 1) <> '' THEN regexp_extract(lower(trim(lang)), '^([a-z]{2,3})(?:[-_].*)?$', 1) ELSE 'und' END AS lang,
        n_chars FROM documents WHERE n_chars > 0),
    leaf AS (SELECT CASE WHEN source IN ('def14a', 's1_bios') THEN 'filings' WHEN source IN ('npx_rationale', 'policy_notes') THEN 'votes'
        WHEN source IN ('letters_13f', 'holder_comments') THEN 'investors' WHEN source IN ('forum_posts', 'run_notes') THEN 'informal' ELSE source END AS domain,
        lang, source, source AS name, CAST(sum(n_chars) AS DOUBLE) AS held, any_value(target_share) * sum(n_chars) / sum(sum(n_chars)) OVER (PARTITION BY source) AS weight,
        CAST(sum(n_chars) * any_value(max_repeats) AS DOUBLE) AS capacity FROM d JOIN mix_targets USING (source) GROUP BY lang, source),
    lang AS (SELECT domain, lang, lang AS name, sum(weight) AS weight, sum(capacity) AS capacity FROM leaf WHERE weight > 0 GROUP BY ALL),
    dom AS (SELECT 1 AS one, domain, domain AS name, sum(weight) AS weight, sum(capacity) AS capacity FROM lang GROUP BY ALL),
    top AS (SELECT 1 AS one, least(sum(held), sum(capacity) FILTER (weight > 0)) AS budget FROM leaf),"""
    + _fill("top", "dom", "dom_b", "one") + "," + _fill("dom_b", "lang", "lang_b", "domain") + "," + _fill("lang_b", "leaf", "leaf_b", "domain, lang")
    + """
    SELECT l.domain, l.lang, l.source, round(l.weight, 6) AS weight, l.capacity, round(coalesce(b.budget, 0), 1) AS budget
    FROM leaf l LEFT JOIN leaf_b b ON b.domain = l.domain AND b.lang = l.lang AND b.source = l.source
    """,
)
def p8_budgets(spark, sf_dir):
    """Budgets of the leaves where the mixture is as large as the documents and short sources' shares move on; sizes in characters, which SQL can count too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.plain_source("source").alias("source"), mixing.plain_language("lang").alias("lang"), F.col("n_chars").alias("n_tokens"))
    got = mixing.budgets(docs, table(spark, sf_dir, "mix_targets"), DOMAINS, all_held=True)
    return got.withColumn("weight", F.round("weight", 6)).withColumn("budget", F.round("budget", 1))


def _variants(spark, sf_dir):
    own = table(spark, sf_dir, "own_rows").where("not coalesce(is_group_row, false)").select(F.col("holder_name").alias("name"), F.col("cik").alias("place"))
    s1 = table(spark, sf_dir, "s1_persons").select(F.col("name_raw").alias("name"), F.col("cik").alias("place"))
    names = variants.stored_names([(table(spark, sf_dir, "split_s12"), "fundname", True), (own, "name", False), (s1, "name", False)])
    return variants.link_variants(names, own.unionByName(s1))


@R.add("p5_found")
def p5_found(spark, sf_dir):
    return variants.variant_pairs(_variants(spark, sf_dir))


@R.add("p5_clusters")
def p5_clusters(spark, sf_dir):
    """One row per stored name with its cluster and the number of spellings in it."""
    c = _variants(spark, sf_dir)
    size = c.groupBy("cluster").agg(F.count("*").alias("n_spellings"))
    return c.join(size, "cluster")


def _units(spark, sf_dir):
    """Classes of one fund: joined by portfolio or by wficn."""
    classes, links = table(spark, sf_dir, "portnomap"), table(spark, sf_dir, "mflink_portno")
    edges = classes.select(F.col("crsp_fundno").alias("node"), F.concat(F.lit("p"), "crsp_portno").alias("hub"))
    edges = edges.unionByName(links.join(classes.select("crsp_fundno").distinct(), "crsp_fundno", "left_semi").select(F.col("crsp_fundno").alias("node"), F.concat(F.lit("w"), "wficn").alias("hub")))
    alone = classes.where("crsp_fundno is not null").select(F.col("crsp_fundno").alias("node"), F.concat(F.lit("c"), "crsp_fundno").alias("hub"))
    return linkage.components(edges.unionByName(alone))


def _links(spark, sf_dir):
    holds = table(spark, sf_dir, "split_s12").where("fundno is not null")
    size = F.when(F.col("assets") > 0, F.ln(F.col("assets") / 100))
    left = holds.groupBy(F.col("fundno").alias("fund"), F.col("fundname").alias("title"), F.col("mgrcoab").alias("manager"), F.col("ioc").cast("string").alias("objective")).agg(
        F.count("*").alias("n"), F.sum(size).alias("log_sum"), F.count(size).alias("log_n"), F.min("rdate").alias("first"), F.max("rdate").alias("last")
    )
    unit = written(_units(spark, sf_dir), "units")
    classes = table(spark, sf_dir, "portnomap").join(unit.withColumnRenamed("node", "crsp_fundno"), "crsp_fundno")
    # A fund's assets are those of all its classes: each row of a class stands for the whole unit.
    tna = classes.where("tna_latest > 0").groupBy("unit", "crsp_fundno").agg(F.avg("tna_latest").alias("t")).groupBy("unit").agg(F.ln(F.sum("t")).alias("log_size"))
    right = classes.groupBy("unit", F.col("fund_name").alias("title"), F.col("mgmt_name").alias("manager"), F.col("crsp_obj_cd").alias("objective")).agg(
        F.count("*").alias("n"), F.min("begdt").alias("first"), F.max(F.coalesce("enddt", F.lit("9999-12-31").cast("date"))).alias("last")
    )
    right = right.join(tna, "unit", "left").select("*", F.col("log_size").alias("log_sum"), F.when(F.col("log_size").isNotNull(), 1).alias("log_n")).drop("log_size")
    right = right.withColumn("log_sum", F.col("log_sum") * F.col("n")).withColumn("log_n", F.col("log_n") * F.col("n"))
    return linkage.link_funds(written(left, "left"), written(right, "right")), unit


@R.add("p1_found")
def p1_found(spark, sf_dir):
    links, unit = _links(spark, sf_dir)
    return links.join(unit, "unit").select(F.col("fund").alias("fundno"), F.col("node").alias("crsp_fundno"))


@R.add("p1_links")
def p1_links(spark, sf_dir):
    """The same with the confidence, and the wficn where MFLINKS has one."""
    links, unit = _links(spark, sf_dir)
    w = table(spark, sf_dir, "mflink_portno").where("wficn is not null").groupBy("crsp_fundno").agg(F.min("wficn").alias("wficn"))
    out = links.join(unit, "unit").select(F.col("fund").alias("fundno"), F.col("node").alias("crsp_fundno"), F.round("confidence", 6).alias("confidence"))
    return out.join(w, "crsp_fundno", "left")


def _scored(spark, sf_dir, docs, keep):
    return abuse.score_documents(docs, keep, table(spark, sf_dir, "doc_labels"))


@R.add("p9_found")
def p9_found(spark, sf_dir):
    return _scored(spark, sf_dir, table(spark, sf_dir, "documents"), ["doc_id"]).where("score >= 0.5").select("doc_id").distinct()


@R.add("p9_scores")
def p9_scores(spark, sf_dir):
    return _scored(spark, sf_dir, table(spark, sf_dir, "documents"), ["doc_id"])


@R.add("p9_rates")
def p9_rates(spark, sf_dir):
    """Share of documents with such content per source."""
    docs = table(spark, sf_dir, "documents").withColumn("source", F.coalesce(mixing.plain_source("source"), F.lit("unknown")))
    s = _scored(spark, sf_dir, docs, ["doc_id", "source"])
    hit = lambda c: F.count(F.when(F.col(c) >= 0.5, 1))
    out = s.groupBy("source").agg(F.count("*").alias("n_docs"), hit("score").alias("n_cases"), *[hit(c).alias(f"n_{c}") for c in ("abusive", "hateful", "sexual")])
    return out.withColumn("rate", F.col("n_cases") / F.col("n_docs"))
