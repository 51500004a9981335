"""Linking fund names to units by a ladder of seven tiers; the first that links a name decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import resolution as E
from marlstone.operators.dedup import first_of
from marlstone.session import written

TIERS = ["exact", "ticker", "scoped", "global", "feeder_master", "digit_split", "header"]

# Words that tell a master fund from its feeder, or one vendor's spelling from another's; words of firms that aren't their names; words of strategies.
STRUCTURAL = ["MASTER", "FEEDER", "SERIES", "PORTFOLIO", "PORTFOLIOS", "FUND", "FUNDS", "TRUST", "TRUSTS", "ACCOUNT", "ACCOUNTS", "SEPARATE", "POOL", "POOLED", "SHARES", "CLASS"]
FIRM = ["ASSET", "ASSETS", "MANAGEMENT", "MANAGERS", "MANAGER", "MGMT", "MNGMT", "INVESTMENT", "INVESTMENTS", "INVESTOR", "INVESTORS", "INVT", "INVS", "ADVISORS", "ADVISERS", "ADVISOR", "ADVISER", "ADVISORY", "ADVS", "FUND", "FUNDS", "GROUP", "CAPITAL", "TRUST", "TRUSTS", "HOLDINGS", "PARTNERS", "PTNRS", "GLOBAL", "INTERNATIONAL", "SERVICES", "FINANCIAL", "AMERICA", "COMPANY", "LIMITED"]
STRATEGY = ["SMALL", "LARGE", "MID", "MIDCAP", "SMALLCAP", "MICROCAP", "MICRO", "CAP", "GROWTH", "VALUE", "INDEX", "EQUITY", "EQUITIES", "INCOME", "BOND", "BONDS", "CORE", "SELECT", "BLEND", "VARIABLE", "INSURANCE", "INSTITUTIONAL", "TAX", "MANAGED", "MULTI", "ALL", "US", "USA", "GLOBAL", "INTERNATIONAL", "EMERGING", "MARKETS", "MARKET", "REAL", "ESTATE", "TOTAL", "STOCK", "BALANCED", "STRATEGIC", "OPPORTUNITIES", "OPPORTUNITY", "THE", "NEW", "AGGRESSIVE", "MODERATE", "CONSERVATIVE", "HIGH", "YIELD", "SHORT", "LONG", "TERM", "DIVERSIFIED", "ACTIVE", "PASSIVE", "DYNAMIC", "FOCUSED", "PREMIER", "ADVANTAGE", "RETIREMENT", "TARGET", "LIFEPATH", "FOCUS", "SPECIAL", "PRIME", "PLUS", "ULTRA", "ENHANCED", "DISCIPLINED", "SYSTEMATIC", "QUALITY", "DIVIDEND", "APPRECIATION", "YORK", "UNITED", "STATES"]
SPELLED_OUT = {"FD": "FUND", "FND": "FUND", "FDS": "FUNDS", "FNDS": "FUNDS", "PTF": "PORTFOLIO", "PORT": "PORTFOLIO", "TR": "TRUST", "SER": "SERIES", "MSTR": "MASTER"}
# What follows a trust's name; a wrapper that names the fund it holds in parentheses; what comes before a former name; tails that are not the fund's name.
TAIL = r"^.+(?:\s[-–—:]\s+|:\s+|\b(?:TR|TRUST|FDS|FUNDS|SER|SERIES)\s?[-:/]\s*)(.+)$"
WRAPPER = r"\b(?:SEPARATE\s+ACCOUNT|SUB[\s-]?ACCOUNT|VA[\s-]?\d|VARIABLE\s+ACCOUNT)\b"
FORMER = r"\(\s*(?:FORMERLY(?:\s+KNOWN\s+AS)?|F/?K/?A)\s*:?\s*([^)]+)\)"
NO_NAME = [r"\s[-–]\s*(?:SUB[- ]?ADVIS\w*|ADVIS\w*)\b.*$", r"\s+(?:EQUITY\s+)?SLEEVE\b.*$", r"\b(?:CL|CLASS)\s+[A-Z0-9]{1,3}\b|\bINC\b|\bLTD\b"]


def _words(*ws: str) -> Column:
    return F.array(*[F.lit(w) for w in ws])


def houses(firm: Column | str) -> Column:
    """The words of a firm's name that are its own; none for null."""
    plain = F.regexp_replace(F.upper(S.col(firm)), "[^A-Z0-9]+", " ")
    return F.coalesce(S.family_tokens(plain, [*FIRM, *STRATEGY]), F.array().cast("array<string>"))


def core(form: Column) -> Column:
    return F.array_join(F.array_except(S.tokens(form), _words(*STRUCTURAL)), " ")


def forms(name: Column, raw: Column, own: Column) -> Column:
    """The ways to read a spelling: as it is, less one or two leading codes, less the sponsor's words, after a trust's name, and what a wrapper holds."""
    upper, plain = F.upper(raw), lambda c: S.expand_abbreviations(S.normalize_name(c), SPELLED_OUT)
    name = S.expand_abbreviations(name, SPELLED_OUT)
    drop = lambda c: F.regexp_replace(c, S.CODE_PREFIX, "")
    ws = S.tokens(name)
    at = F.array_position(F.transform(ws, lambda w: F.array_contains(own, w)), False).cast("int")
    sponsor = F.when((at > 1) & (F.size(ws) - at + 1 >= 2), F.array_join(F.slice(ws, F.greatest(at, F.lit(1)), F.size(ws)), " "))
    tail = F.regexp_extract(upper, TAIL, 1)
    held = F.when(upper.rlike(WRAPPER), F.regexp_extract(upper, r"\(([^)]*)\)", 1))
    return F.array_distinct(F.array_compact(F.array(name, drop(name), drop(drop(name)), sponsor, F.when(tail != "", plain(tail)), F.when(held != "", plain(held)))))


def variants(raw: Column) -> Column:
    """Every spelling of a name worth a look in the vocabulary: less codes, former names, tails of advisers and sleeves, classes; the former name too."""
    up = F.upper(raw)
    plain = lambda c: S.squeeze(F.regexp_replace(c, "[^A-Z0-9]+", " "))
    former = F.regexp_extract(up, FORMER, 1)
    all_of = [up, F.regexp_replace(up, S.CODE_PREFIX, ""), F.when(former != "", F.regexp_replace(up, FORMER, "")), F.when(former != "", former), *[F.regexp_replace(up, p, " ") for p in NO_NAME]]
    return F.array_distinct(F.filter(F.array_compact(F.array(*[plain(c) for c in all_of])), lambda v: v != ""))


def same_words(a: Column, b: Column, own: Column) -> Column:
    """Each word of either name but structural and ``own`` ones has its counterpart in the other: equal, an abbreviation, or one or two letters off."""
    left = F.array_except(S.tokens(S.expand_abbreviations(a, SPELLED_OUT)), F.array_union(own, _words(*STRUCTURAL)))
    right = F.array_except(S.tokens(S.expand_abbreviations(b, SPELLED_OUT)), F.array_union(own, _words(*STRUCTURAL)))
    short = lambda x, y: F.rlike(y, F.concat(F.lit("^"), F.regexp_replace(x, "(.)", "$1.*")))
    digits = lambda x: x.rlike("[0-9]")
    near = lambda x, y: (x == y) | (~digits(x) & ~digits(y) & ((F.length(x) >= 2) & short(x, y) | (F.length(x) >= 4) & (F.levenshtein(x, y) <= F.when(F.length(x) >= 6, 2).otherwise(1))))
    return F.forall(left, lambda x: F.exists(right, lambda y: near(x, y))) & F.forall(right, lambda y: F.exists(left, lambda x: near(x, y)))


def _less(ids: DataFrame, *done: DataFrame) -> DataFrame:
    return reduce(lambda d, x: d.join(x.select(F.col("left_id").alias("id")), "id", "left_anti"), done, ids)


def by_id(of: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links by exact id, ``left_id, unit, score``, and what the ids leave open (``left_id, unit``).

    A name that is a unit's name; else the one unit that the names of the same ``member`` (the fund's number) are.  Where
    these are several units, they are open.
    """
    same = of.select("id").join(units.select(F.col("unit").alias("id")), "id").select(F.col("id").alias("left_id"), F.col("id").alias("unit"))
    named = of.select(F.col("id").alias("left_id"), F.explode("members").alias("member"))
    known = named.join(same, "left_id").select("member", "unit").distinct()
    meant = written(named.join(same, "left_id", "left_anti").join(known, "member").select("left_id", "unit").distinct(), "attested")
    one = meant.groupBy("left_id").agg(F.count("*").alias("n"), F.min("unit").alias("unit"))
    links = same.unionByName(one.where("n = 1").drop("n")).withColumn("score", F.lit(1.0))
    return links, meant.join(one.where("n > 1").select("left_id"), "left_id", "left_semi")


def by_ticker(open_: DataFrame, right: DataFrame, of: DataFrame, known: DataFrame, alike: float = 0.45) -> DataFrame:
    """Links by ticker: from the units that ids leave open over their classes' tickers to the unit that bears most of these, and more than any other.

    A ticker may be given to another fund later, so a second sign is asked for: two tickers, a word of the family, or a similar name.
    """
    t = F.upper(F.trim("ticker"))
    bears = right.select("unit", F.when(~t.isin("", "N/A", "NA", "-"), t).alias("ticker")).where("ticker is not null").distinct()
    if open_.isEmpty():
        return open_.withColumn("score", F.lit(1.0))
    hits = open_.join(bears, "unit").select("left_id", "ticker").distinct().join(bears, "ticker").groupBy("left_id", F.col("unit").alias("right_id")).agg(F.count("*").cast("double").alias("score"))
    best = E.best_margin(hits, bears.select(F.col("unit").alias("right_id"), "unit").distinct()).where("margin > 0")
    best = best.join(of.select(F.col("id").alias("left_id"), "claims"), "left_id").join(known.select("unit", "houses"), "unit")
    sure = (F.col("score") >= 2) | F.arrays_overlap("claims", F.concat(S.tokens("unit"), "houses"))
    best = written(best.select("left_id", "unit", sure.alias("sure")), "tickers")
    doubt = best.where("not sure")
    pair = lambda c: doubt.select(F.col(c).alias("id"), F.col(c).alias("name"), F.col("left_id").alias("pair"))
    near = E.similar(pair("left_id"), pair("unit"), alike, None, "pair").select("left_id", F.col("right_id").alias("unit"))
    return best.where("sure").select("left_id", "unit").unionByName(near).withColumn("score", F.lit(1.0))


def by_name(names: DataFrame, units: DataFrame, rest: DataFrame, scoped: float = 0.8, anywhere: float = 0.85) -> DataFrame:
    """Best match within the scope, else anywhere, among pairs whose numbers and designators agree; ``step`` tells which."""
    near = E.similar(names, units, min(scoped, anywhere), None, only=rest).where(E.digit_guard("left_id", "right_id"))
    scope = lambda c: F.substring(c, 1, 1)
    step = F.when((scope("left_id") == scope("right_id")) & (F.col("score") >= scoped), 0).when(F.col("score") >= anywhere, 1)
    found = near.select("left_id", F.col("right_id").alias("unit"), "score", step.alias("step")).where("step is not null")
    return first_of(found, ["left_id"], [F.asc("step"), F.desc("score"), F.asc("unit")])


def _attested(links: DataFrame, of: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """``house, to``: the houses that at least ``share`` of the links of a house's funds go to."""
    own = of.select(F.col("id").alias("left_id"), F.explode("houses_l").alias("house"))
    g = links.select("left_id", "unit").join(own, "left_id").join(known.select("unit", F.explode("houses").alias("to")), "unit").groupBy("house", "to").agg(F.count("*").alias("n"))
    return g.withColumn("of", F.sum("n").over(Window.partitionBy("house"))).where(F.col("n") >= share * F.col("of")).select("house", "to")


def by_core(of: DataFrame, known: DataFrame, borne: DataFrame, links: DataFrame, rest: DataFrame, split: bool, bar: float = 0.97, share: float = 0.02, margins: tuple[float, float] = (0.005, 0.02)) -> DataFrame:
    """Links of names that are one but for structural words, leading codes or a sponsor: a master fund and its feeder.

    Every form of a left name, with and without its firm's words, meets every unit's name, both whole and without structural
    words.  Numbers and designators of the forms must agree.  A pair of other families is no candidate, unless links by id
    show that the left firm's funds go to the right firm: so pairs are sought within equal words of firms (``borne``) only.
    Within firms known by links ``bar`` and a small margin are asked for, elsewhere the family's word, more words and a
    larger margin.  A second pass knows the firms that the first pass linked.  ``split``: a blank at each boundary of letters
    and digits on both sides; designators are read before.  Names that meet no such boundary are as they were without.
    """
    cut = S.split_digits if split else lambda c: c
    digits = lambda c: F.array_join(S.digit_tokens(cut(c)), " ")
    floor = bar - max(margins)
    usable = lambda c: (F.length(c) >= 8) & (F.size(S.tokens(c)) >= 2)

    def texts(form: Column, whole: Column) -> Column:
        return F.array(*[F.struct(form.alias("form"), F.lit(c).alias("core"), cut(core(whole) if c else whole).alias("name")) for c in (False, True)])

    def read(s: Column) -> Column:
        firm = lambda f: F.array_join(F.array_except(s["own"], S.tokens(f)), " ")
        return F.flatten(F.transform(forms(F.col("id"), s["raw"], s["own"]), lambda f: F.concat(texts(f, f), texts(f, F.trim(F.concat_ws(" ", f, firm(f)))))))

    # The words of a unit by which it may be found; the spaces are kept apart by the scope too.
    within = lambda c: F.concat(F.col(c), F.lit("/"), F.col("core").cast("string"))
    found_by = known.select("unit", F.explode(F.array_union(S.tokens("unit"), "houses")).alias("word")).join(borne.select(F.col("w").alias("word")), "word", "left_semi")
    mine = of.join(rest, "id", "left_semi").select("id", F.explode(F.array_distinct(F.flatten(F.transform("spelled", read)))).alias("s"))
    mine = mine.select("id", "s.*").where(usable(F.col("name")))
    told = of.drop("spelled").join(rest, "id", "left_semi")
    if split:
        fused = found_by.where(S.split_digits("unit") != F.col("unit")).select("word").distinct()
        near = told.select("id", F.explode(F.array_union("claims", "houses_l")).alias("word")).join(fused, "word", "left_semi").select("id")
        # A form whose numbers no unit has can't be linked.
        able = known.select(digits(S.expand_abbreviations("unit", SPELLED_OUT)).alias("digits")).distinct()
        parted = mine.where(S.split_digits("form") != F.col("form")).select("id", digits(F.col("form")).alias("digits")).join(able, "digits", "left_semi")
        told = told.join(parted.select("id").unionByName(near), "id", "left_semi")
        mine = mine.join(told.select("id"), "id", "left_semi")
    mine, told = written(mine, "forms"), written(told, "claims")
    if told.isEmpty():
        return links.select("left_id", "unit", "score").limit(0)
    unit = S.expand_abbreviations("unit", SPELLED_OUT)
    theirs = known.select("unit", F.explode(texts(unit, unit)).alias("s")).select("unit", "s.core", "s.name").where(usable(F.col("name"))).join(found_by, "unit")
    theirs = written(theirs.select(F.struct("unit", "core").alias("id"), "name", within("word").alias("scope")), "forms")
    over = E.weighed(mine, theirs, ["scope"])
    generic = F.array_union(_words(*STRATEGY), _words(*STRUCTURAL))

    def settle(told: DataFrame, to: DataFrame) -> DataFrame:
        allowed = told.select("id", F.explode("houses_l").alias("house")).join(to, "house").groupBy("id").agg(F.collect_set("to").alias("allowed"))
        known_l = written(told.join(allowed, "id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>"))), "claims")
        m = mine.join(known_l.select("id", F.explode(F.array_union("claims", "allowed")).alias("word")), "id").withColumn("scope", within("word"))
        own = F.size(F.array_except(F.filter(S.tokens("form"), lambda w: ~w.rlike("^[0-9]+$")), generic)) > 0
        about = [digits(F.col("form")).alias("digits"), S.designator("form").alias("designator"), F.size(S.tokens("form")).alias("n"), own.alias("own")]
        m = m.join(theirs.select("scope").distinct(), "scope", "left_semi").select(F.struct("id", "core", *about).alias("id"), "name", "scope")
        a, b = F.col("left_id"), F.col("right_id")
        named = S.expand_abbreviations(b["unit"], SPELLED_OUT)
        p = E.similar(m, theirs, floor, None, "scope", over=over).where((a["digits"] == digits(named)) & a["designator"].eqNullSafe(S.designator(named)))
        p = p.select("left_id.*", b["unit"].alias("unit"), "score").join(known_l, "id").join(known, "unit")
        p = p.where(F.coalesce(F.col("last") >= F.col("first") - 1, F.lit(True)))
        scoped, family = F.arrays_overlap("allowed", "houses"), F.arrays_overlap("claims", F.concat(S.tokens("unit"), "houses"))
        p = p.select(F.col("id").alias("left_id"), F.col("unit").alias("right_id"), "score", "core", scoped.alias("scoped"), family.alias("family"), "n", "own")
        p = written(p, "pairs")
        units = p.select("right_id", F.col("right_id").alias("unit")).distinct()
        inside = F.col("scoped") & ((F.col("n") >= 3) | ((F.col("n") >= 2) & F.col("family")))
        outside = F.col("family") & F.col("own") & (F.col("n") >= 4)
        ways = [(space & fits, least) for space in (~F.col("core"), F.lit(True)) for fits, least in zip((inside, outside), margins)]
        best = [E.best_margin(p.where(w).select("left_id", "right_id", "score"), units).where((F.col("score") >= bar - 1e-9) & (F.col("margin") >= least)).withColumn("way", F.lit(i)) for i, (w, least) in enumerate(ways)]
        return written(first_of(reduce(DataFrame.unionByName, best), ["left_id"], [F.asc("way")]), "links")

    to = written(_attested(links, of, known, share), "houses")
    one = settle(told, to)
    new = _attested(links.select("left_id", "unit").unionByName(one.where("way in (1, 3)").select("left_id", "unit")), of, known, share).join(to, ["house", "to"], "left_anti")
    new = written(new, "houses")
    # Only names whose firm is now known to go elsewhere too can come out otherwise than before.
    moved = _less(told, one).select("id", F.explode("houses_l").alias("house")).join(new, "house", "left_semi").select("id").distinct()
    told = written(told.join(moved, "id", "left_semi"), "claims")
    if told.isEmpty():
        return one.select("left_id", "unit", "score")
    return one.unionByName(settle(told, to.unionByName(new))).select("left_id", "unit", "score")


def by_vocabulary(of: DataFrame, right: DataFrame, series: DataFrame, rest: DataFrame, strong: float = 0.85, weak: float = 0.7, margin: float = 0.02) -> DataFrame:
    """Links by the vocabulary of headers: every variant of a name against titles, titles after their trusts' names, and the names of series in submission headers.

    No scope; a word of the firm's name lets a weaker score in.  A name of several units, or another unit close behind, decides nothing.
    What it proposes is judged word by word (:func:`same_words`).  ``series``: ``name, ticker``; a series is the unit that
    bears its class's ticker.
    """
    plain = lambda c: S.squeeze(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))
    headed = right.select("unit", F.explode(F.array_compact(F.array(F.col("unit"), plain("title"), plain("heading")))).alias("name"))
    filed = series.join(right.where("ticker is not null").select("unit", "ticker").distinct(), "ticker").select("unit", plain("name").alias("name"))
    vocabulary = headed.unionByName(filed).where("name != ''").groupBy("name").agg(F.min("unit").alias("unit"), F.when(F.min("unit") == F.max("unit"), 1).otherwise(2).alias("n"))
    vocabulary = vocabulary.select(F.struct("unit", "n", "name").alias("id"), "name")
    each = of.join(rest, "id", "left_semi").select("id", F.explode(F.array_distinct(F.flatten(F.transform("spelled", lambda s: variants(s["raw"]))))).alias("name"))
    each = each.select(F.struct("id", "name").alias("id"), "name")
    a, b = F.col("left_id"), F.col("right_id")
    p = E.similar(each, vocabulary, weak - margin, None).where(E.digit_guard(a["name"], b["name"]))
    g = p.groupBy(a["id"].alias("left_id"), b["unit"].alias("unit")).agg(F.max(F.struct("score", (-b["n"]).alias("n"), a["name"].alias("a"), b["name"].alias("b"))).alias("m"))
    w = Window.partitionBy("left_id").orderBy(F.desc("m.score"), F.asc("unit"))
    two = g.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    best = two.groupBy("left_id").agg(F.max(F.when(F.col("rn") == 1, F.struct("m", "unit"))).alias("b"), F.max(F.when(F.col("rn") == 2, F.col("m.score"))).alias("second"))
    best = best.join(of.select(F.col("id").alias("left_id"), "houses_l"), "left_id")
    family = F.arrays_overlap("houses_l", S.tokens("b.m.b"))
    ok = (F.col("b.m.n") == -1) & ((F.col("b.m.score") >= strong) | ((F.col("b.m.score") >= weak) & family)) & (F.col("b.m.score") - F.coalesce("second", F.lit(0.0)) >= margin)
    best = best.where(ok & same_words(F.col("b.m.a"), F.col("b.m.b"), F.col("houses_l")))
    return best.select("left_id", F.col("b.unit").alias("unit"), F.col("b.m.score").alias("score"))


def tier_ladder(left: DataFrame, right: DataFrame, series: DataFrame) -> DataFrame:
    """``left_id, unit, tier, score``: exact id, ticker, scoped, global, feeder and master, digits split, vocabulary of headers; each tier sees what the ones before left.

    ``left``: ``id, raw, members, firms, first``, a row per spelling; ``id`` is the normalised name, ``members`` the numbers
    of its funds, ``firms`` their managers, ``first`` the first year.  ``right``: ``unit, title, heading, ticker, firm, last``; ``unit`` is the normalised
    title.  ``series``: ``name, ticker`` of submission headers.
    """
    right = written(right, "right")
    known = right.groupBy("unit").agg(F.array_distinct(F.flatten(F.collect_set(houses("firm")))).alias("houses"), F.max("last").alias("last"))
    known = written(known, "units")
    owns = F.array_distinct(F.concat(F.array(houses(F.lit(None).cast("string"))), F.transform("firms", houses)))
    left = left.withColumn("spelled", F.transform(owns, lambda o: F.struct(F.col("raw").alias("raw"), o.alias("own"))))
    of = left.groupBy("id").agg(F.flatten(F.collect_list("spelled")).alias("spelled"), F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"), F.min("first").alias("first"))
    of = written(of.withColumn("houses_l", F.array_distinct(F.flatten("spelled.own"))), "names")
    # A word of a name claims a family only if some firm bears it.
    borne = written(of.select(F.explode("houses_l").alias("w")).unionByName(known.select(F.explode("houses").alias("w"))).distinct(), "words")
    said = of.select("id", F.explode(S.tokens("id")).alias("w")).join(borne, "w").groupBy("id").agg(F.collect_set("w").alias("said"))
    of = of.join(said, "id", "left").withColumn("claims", F.array_union("houses_l", F.coalesce("said", F.array().cast("array<string>")))).drop("said")
    of = written(of, "names")
    ids, named = of.select("id"), lambda d, c: d.select(F.col(c).alias("id"), F.col(c).alias("name"))

    same, open_ = by_id(of, known)
    exact = written(same, "links")
    ticker = written(by_ticker(open_, right, of, known), "links")
    near = written(by_name(named(ids, "id"), named(known, "unit"), _less(ids, exact, ticker)), "links")
    known_by_id = exact.unionByName(ticker)
    rest = written(_less(ids, exact, ticker, near), "names")
    feeder = written(by_core(of, known, borne, known_by_id, rest, False), "links")
    split = written(by_core(of, known, borne, known_by_id, _less(rest, feeder), True), "links")
    header = written(by_vocabulary(of, right, series, _less(rest, feeder, split)), "links")
    tiers = [exact, ticker, near.where("step = 0"), near.where("step = 1"), feeder, split, header]
    # No name is in two tiers, as each is given what the ones before left.
    return reduce(DataFrame.unionByName, [d.select("left_id", "unit", F.lit(n).alias("tier"), "score") for n, d in zip(TIERS, tiers)])
