"""Name matching in passes: override, exact, token, token and club, fuzzy; what is ambiguous stays unmatched.

Names, people and what is made of them are joined by merges: Spark would take
them for small by the bytes of the files they come from, and send all of their
pieces through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.text import normalise, partial_ratio_udf, token_sort_ratio_udf
from scoreloom.session import materialise

# Other names of clubs, after normalising.
CLUB_ALIASES = {
    "man utd": "manchester united",
    "man city": "manchester city",
    "spurs": "tottenham hotspur",
    "wolves": "wolverhampton wanderers",
    "nott'm forest": "nottingham forest",
    "sheffield utd": "sheffield united",
    "newcastle": "newcastle united",
    "brighton": "brighton and hove albion",
    "west brom": "west bromwich albion",
    "west ham": "west ham united",
    "leeds": "leeds united",
}
LEAST = 90.0
#: Pairs of a club and a team that match up to which they are broadcast: some 10 MB at most.
BROADCAST_CLUBS = 50_000


def club(c: Column) -> Column:
    n = normalise(c)
    pairs = [x for kv in CLUB_ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in pairs]), n), n)


def _only(df: DataFrame, key: str) -> DataFrame:
    """Keys that lead to exactly one code."""
    return df.groupBy(key).agg(F.min("code").alias("code"), F.max("code").alias("__max")).where("code = __max").select(key, "code")


def _sorted_tokens(name: str) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(name), "\\s+")), " ")


def _by_blocks(names: DataFrame, people: DataFrame, least: float) -> DataFrame:
    """Pairs (raw_name, n, full_n, code) of one lane that may reach the ratio, by an equi-join that loses none of them.

    A ratio of r between texts of a and b characters leaves at most
    d = (a + b)(1 - r / 100) characters that aren't common, in order, to
    both. Cut the longer text into d + 1 pieces: one piece is then untouched
    and stands in the other text as it is, moved by at most d characters. So
    the names' pieces meet the same piece at any such place of the people's
    names of a length that the ratio allows; both are sorted by tokens first,
    as the ratio does.
    """
    names, people = (df if "lane" in df.columns else df.withColumn("lane", F.lit("")) for df in (names, people))
    slack = 1 - least / 100
    # Lengths b with 2 * min / (a + b) >= r lie between a * r / (2 - r) and a * (2 - r) / r.
    low, high = (1 - slack) / (1 + slack), (1 + slack) / (1 - slack)
    left = names.select("raw_name", "n", "lane", _sorted_tokens("n").alias("s")).withColumn("a", F.length("s")).where("a > 0")
    cuts = F.floor(F.col("a") * (1 + high) * slack).cast("int") + 1
    left = left.withColumn("pieces", F.least(cuts, F.col("a"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    start = F.floor(F.col("a") * F.col("i") / F.col("pieces")).cast("int")
    left = left.select("raw_name", "n", "lane", F.col("s").alias("sl"), "a", start.alias("at"), F.expr("substring(s, int(floor(a * i / pieces)) + 1, int(floor(a * (i + 1) / pieces)) - int(floor(a * i / pieces)))").alias("piece"))
    lengths = F.sequence(F.floor(F.col("a") * low).cast("int"), F.ceil(F.col("a") * high).cast("int"))
    left = left.withColumn("b", F.explode(lengths))
    # Of a person's name pieces are taken as long as those of names that its length suits; lengths are few.
    sizes = left.select("b", F.length("piece").alias("size")).distinct()
    right = people.withColumn("s", _sorted_tokens("full_n")).withColumn("b", F.length("s")).where("b > 0")
    grams = right.join(F.broadcast(sizes), "b").where("size <= b").select("full_n", "code", "lane", "b", F.col("s").alias("sr"), F.posexplode(F.transform(F.sequence(F.lit(1), F.expr("b - size + 1")), lambda p: F.substring("s", p, F.col("size")))).alias("place", "piece"))
    far = F.ceil((F.col("a") + F.col("b")) * slack)
    met = left.join(grams.hint("merge"), ["lane", "b", "piece"]).where(F.abs(F.col("place") - F.col("at")) <= far)
    # Edits are no more than insertions and deletions, so this drops no pair; it is quick, and spares the shuffle.
    met = met.where(F.levenshtein("sl", "sr") <= F.floor((F.col("a") + F.col("b")) * slack + 1e-9))
    return met.select("raw_name", "n", "full_n", "code").distinct()


def _one_off(names: DataFrame, people: DataFrame) -> DataFrame:
    """Pairs (raw_name, n, full_n, code) of one lane whose texts, sorted by tokens, are equal or a character short of one another.

    Equi-joins of the texts and of what they are without one character. Where
    a name of three characters or more has such a pair, none that is further
    off has as high a ratio: 2 / (a + b) is at least 1 / (a + 1) for a length
    b <= a + 2, and one character costs 1 / (2 a - 1) at most.
    """
    left = names.select("raw_name", "n", "lane", _sorted_tokens("n").alias("s")).where("length(s) > 2")
    right = people.select("full_n", "code", "lane", _sorted_tokens("full_n").alias("s")).where("s <> ''")
    without = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.concat(F.substring("s", F.lit(1), i - 1), F.substring("s", i + 1, F.length("s"))))))
    longer, shorter = left.withColumn("s", without), right.withColumn("s", without)
    right, shorter = right.hint("merge"), shorter.hint("merge")
    found = left.join(right, ["lane", "s"]).unionByName(longer.join(right, ["lane", "s"])).unionByName(left.join(shorter, ["lane", "s"]))
    return found.select("raw_name", "n", "full_n", "code").distinct()


def _club_scores(clubs: DataFrame, teams: DataFrame, least: float) -> DataFrame:
    """(c, team_n, score) of distinct clubs and teams whose partial ratio reaches ``least``, equal ones by a join alone.

    The ratio sets the shorter text, of n characters, against windows of the
    longer: at 90 or more they differ by n (2 - 2 r) edits at most, so of one
    piece more than that one stands in the longer text as it is.
    """
    same = clubs.join(teams.hint("merge"), F.col("c") == F.col("team_n")).withColumn("score", F.lit(100.0))
    slack = 2 - 2 * least / 100

    def meets(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        cut = short.where(F.length(s) > 0).withColumn("k", F.least(F.length(s), F.floor(F.length(s) * slack).cast("int") + 1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        piece = F.expr(f"substring({s}, int(floor(length({s}) * i / k)) + 1, int(floor(length({s}) * (i + 1) / k)) - int(floor(length({s}) * i / k)))")
        cut = cut.select(s, piece.alias("piece"))
        sizes = cut.select(F.length("piece").alias("size")).distinct()
        # Lengths of pieces are fewer than characters of a name.
        grams = long.join(F.broadcast(sizes), F.col("size") <= F.length(t)).select(t, F.explode(F.transform(F.sequence(F.lit(1), F.expr(f"length({t}) - size + 1")), lambda p: F.substring(t, p, F.col("size")))).alias("piece"))
        return cut.join(grams.distinct().hint("merge"), "piece").where(F.length(s) <= F.length(t)).select("c", "team_n").distinct()

    pairs = meets(clubs, "c", teams, "team_n").unionByName(meets(teams, "team_n", clubs, "c")).distinct().where("c <> team_n")
    return same.unionByName(pairs.withColumn("score", partial_ratio_udf("c", "team_n")).where(F.col("score") >= least))


def match_names(raw: DataFrame, directory: DataFrame, overrides: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """raw_name, code and pass of every distinct name of ``raw`` (raw_name, club, seq).

    A name that comes with several clubs has the last one by seq. The
    directory has code, full_name, web_name and team, a row a season. The
    first pass that leads a name to one code settles it; one that leads to
    several leaves it to the next, and what no pass settles has a null code.
    Normal forms and the passes up to tokens are expressions and equi-joins.
    Clubs are compared with teams once a distinct pair. Only the fuzzy pass
    compares names pairwise, what is left of them, with the people of clubs
    that match where there are any, and else with all: first with those at
    most a character off (see :func:`_one_off`), and where there are none with
    those that share a piece of the name (see :func:`_by_blocks`).
    """
    names = raw.where("raw_name is not null").groupBy("raw_name").agg(F.max_by("club", "seq").alias("club"))
    # The normal forms hold thousands of letters, so they stand in two plans and not in each of those that follow.
    names = materialise(names.select("raw_name", normalise(F.col("raw_name")).alias("n"), club(F.col("club")).alias("c")), "names")
    people = materialise(directory.select("code", normalise(F.col("full_name")).alias("full_n"), normalise(F.col("web_name")).alias("web_n"), club(F.col("team")).alias("team_n")), "names-people")
    found: list[DataFrame] = []

    def settle(rows: DataFrame, label: str) -> None:
        found.append(rows.select("raw_name", "code", F.lit(len(found)).alias("rank"), F.lit(label).alias("pass")))

    # What a pass says of a name doesn't hang on other names, so the equi-join passes see all names and the first that settles one holds.
    if overrides is not None:
        # Both sides in normal form; of several overrides of a name the last row holds.
        fixed = overrides.select(normalise(F.col("raw_name")).alias("n"), "code", F.monotonically_increasing_id().alias("__row"))
        settle(names.join(fixed.groupBy("n").agg(F.max_by("code", "__row").alias("code")).hint("merge"), "n"), "override")
    exact = _only(people.select(F.explode(F.array("full_n", "web_n")).alias("n"), "code").where("n <> ''").distinct(), "n")
    settle(names.join(exact.hint("merge"), "n"), "exact")
    tokens = names.select("raw_name", "c", F.explode(F.array_distinct(F.split("n", "\\s+"))).alias("web_n"))
    candidates = tokens.join(people.select("web_n", "code", "team_n").where("web_n <> ''").hint("merge"), "web_n")
    settle(_only(candidates.select("raw_name", "code").distinct(), "raw_name"), "token")
    clubs = names.select("c").where("c <> ''").distinct()
    near = materialise(_club_scores(clubs, people.select("team_n").where("team_n <> ''").distinct(), least), "club-scores")
    few = near.count() <= BROADCAST_CLUBS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df.hint("merge")

    at_club = candidates.join(sent(near), ["c", "team_n"])
    best = at_club.groupBy("raw_name", "code").agg(F.max("score").alias("score")).withColumn("top", F.max("score").over(Window.partitionBy("raw_name"))).where("score = top")
    settle(_only(best, "raw_name"), "token_club")
    settled = reduce(DataFrame.unionByName, found).groupBy("raw_name").agg(F.min_by(F.struct("code", "pass"), "rank").alias("r")).select("raw_name", "r.code", "r.pass")
    settled = materialise(settled, "names-settled")
    left = names.join(settled.select("raw_name").hint("merge"), "raw_name", "left_anti")
    # A name looks among the people of its clubs, each a lane, or in the lane of all people.
    clubbed = left.join(sent(near.select("c", F.col("team_n").alias("lane"))), "c").select("raw_name", "n", "lane")
    asks = materialise(clubbed.unionByName(left.join(sent(near.select("c").distinct()), "c", "left_anti").select("raw_name", "n", F.lit("").alias("lane"))), "names-left")
    folk = people.where("team_n <> ''").select("full_n", "code", F.col("team_n").alias("lane")).unionByName(people.select("full_n", "code", F.lit("").alias("lane"))).distinct()

    def scores(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("score", token_sort_ratio_udf("n", "full_n")).where(F.col("score") >= least).select("raw_name", "code", "score")

    close = materialise(scores(_one_off(asks, folk)), "names-close")
    far = scores(_by_blocks(asks.join(close.select("raw_name").distinct().hint("merge"), "raw_name", "left_anti"), folk, least))
    top = close.unionByName(far).groupBy("raw_name", "code").agg(F.max("score").alias("score")).withColumn("top", F.max("score").over(Window.partitionBy("raw_name"))).where("score = top")
    near_names = _only(top, "raw_name").select("raw_name", "code", F.lit("fuzzy").alias("pass"))
    return names.select("raw_name").join(settled.unionByName(near_names).hint("merge"), "raw_name", "left")
