"""URL filters: longest-matching rules, else a logistic regression on hashed character n-grams of host and path.

All of it, training included, is DataFrame functions. Rules and weights become expressions, so judging shuffles nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (verdict, rule): a rule is a host and the start of a path.
Rule = tuple[str, str]

# The rules of the task.
RULES: tuple[Rule, ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Rules that one expression holds, at most.
MOST_RULES = 2_000
#: Hash buckets of the n-grams, lengths of the n-grams, and the score from which a url is blocked.
BUCKETS = 1 << 14
LENGTHS = (3, 4)
BLOCK_FROM = 0.5
#: Passes over the labelled table, step size, and the weight of the penalty on large weights.
EPOCHS = 60
RATE = 0.3
PENALTY = 0.03
#: Labelled urls, at most: training folds them in one task.
MOST_LABELLED = 2_000

# The labelled table is made by a rule from general words: each word of a topic is paired with words of no topic, which
# stand on both sides. No host of the pages is in it.
UNWANTED = (
    "casino poker roulette blackjack jackpot slots gambling gamble betting bets wager lottery bingo sportsbook "
    "porn porno xxx sex sexy adult erotic nude cams webcam escort hentai fetish hookup "
    "viagra cialis pills pharmacy steroids painkiller slimming "
    "spam scam phishing malware spyware trojan virus ransom keygen crack warez torrent hacked "
    "ads adserver adclick adtrack tracker tracking clicks banner popup popunder affiliate linkfarm backlink "
    "payday loans forex crypto doubler getrich prize winner giveaway replica"
).split()
ORDINARY = (
    "news weather history science museum library university school college garden recipes kitchen cooking bakery "
    "travel hotel railway airport bicycle mountain river forest ocean island village city council parliament court "
    "health hospital doctor nurse dental physics chemistry biology maths geometry algebra astronomy climate energy "
    "music orchestra theatre cinema painting gallery poetry novel books reading writing grammar dictionary language "
    "sport football tennis cricket athletics soundtrack racetrack stadium chess puzzle toys children parents family "
    "software database compiler python linux kernel docs manual tutorial forum wiki encyclopedia archive journal "
    "research institute academy lecture course student teacher exam farmer farming tractor harvest orchard cattle "
    "bank insurance tax pension budget economy market trade shipping harbour factory steel timber furniture carpet "
    "shoes jacket clothing fashion jewellery watch camera photo printer battery engine motor garage tyres truck "
    "essex sussex adoption advice address shadow canada madrid nevada salads roads heads threads "
    "another through thing thought weather there their theory thesis theme nation station motion section edition "
    "thunder matter winter summer letter better paper number member order under inside outside standard table"
).split()
PARTNERS = "online best my free world zone club hub top live go web today plus mega first net home point place shop store download login cheap buy deals".split()
HOST_STARTS = ("", "www.", "m.", "blog.", "shop.")
HOST_ENDS = ("com", "org", "net", "co.uk", "de", "fr", "info", "example.com", "example.net", "example.org")
PATHS = ("", "/", "/en/12", "/de/345/", "/fr/78.html", "/es/9?page=2", "/index.html", "/about", "/a/b/c#top", "/item?id=4&ref=x")
UNWANTED_PATHS = ("/bonus", "/play-now", "/buy-cheap", "/redirect?to=x", "/click?ad=1", "/cams/live", "/win/jackpot", "/seo/links")
ORDINARY_PATHS = ("/article/2021", "/catalogue", "/docs/latest", "/papers/11", "/wiki/page", "/contact", "/lessons/2", "/news/local")


def _labelled() -> list[tuple[str, int]]:
    """Urls and labels, spread evenly over the forms, so that only the topic tells the labels apart."""
    out = [("", 0), ("://", 0), ("http://a.com", 0), ("http://b.org/", 0), ("https://c.net/x", 0)]
    for label, words, own, times in ((1, UNWANTED, UNWANTED_PATHS, 8), (0, ORDINARY, ORDINARY_PATHS, 5)):
        for i, word in enumerate(words):
            for k in range(times):
                partner = PARTNERS[(3 * i + 7 * k) % len(PARTNERS)]
                name = (word, f"{word}-{partner}", f"{partner}{word}", f"{word}{partner}", f"{partner}-{word}")[k % 5]
                start, end = HOST_STARTS[(i + k) % len(HOST_STARTS)], HOST_ENDS[(i + 3 * k) % len(HOST_ENDS)]
                path = own[(i + k) % len(own)] if k % 4 == 3 else PATHS[(i + 3 * k) % len(PATHS)]
                out.append((f"http{'s' * (k % 2)}://{start}{name}.{end}{path}", label))
    return out


#: A small labelled table to learn from: urls of unwanted sites (1) and of ordinary ones (0).
LABELLED = tuple(_labelled())


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else the empty string."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, of the first by code point among equally long
    ones; null without one. A rule fits its host and all subdomains if the path starts with the rule's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found: Column | None = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _bucket_of(mark: str) -> Callable[[Column], Column]:
    return lambda gram: F.pmod(F.xxhash64(F.lit(mark), gram), F.lit(BUCKETS)).cast("int")


def buckets(host: Column, path: Column) -> tuple[Column, Column]:
    """Hash buckets of the character n-grams of host and path, each marked with the part it is of.

    A look-ahead lists overlapping n-grams in one pass, so time is linear in the length of the url.
    """
    out = []
    for mark, part in (("h", F.concat(F.lit("."), host, F.lit("."))), ("p", lower_ascii(path))):
        found = [F.transform(F.regexp_extract_all(part, F.lit(f"(?s)(?=(.{{{n}}}))"), 1), _bucket_of(f"{mark}{n}")) for n in LENGTHS]
        out.append(F.concat(*found))
    return out[0], out[1]


@dataclass
class Model:
    """Weight of each bucket, the last one being the intercept."""

    weights: list[float]


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table as a DataFrame."""
    rows = json.dumps([{"url": url, "label": label} for url, label in LABELLED])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<url:string,label:int>>")))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def _size_factor(grams: Column) -> Column:
    """What an n-gram of a part counts: parts of any length have features of length 1."""
    return 1 / F.sqrt(F.greatest(F.size(grams), F.lit(1)))


def _descent(table: Column) -> Column:
    """Gradient descent on the whole table ``EPOCHS`` times, from weights of 0, each weight stepping by its own scale.

    ``table`` has ``rows``, with label and features ``(j, x)``, and ``columns``, with the same features as ``(i, x)`` and
    the scale of the weight. An epoch takes the errors of all rows and then moves all weights, so the order is no matter.
    """

    def epoch(w: Column, t: Column) -> Column:
        def error(row: Column) -> Column:
            return _sigmoid(F.aggregate(row["f"], F.lit(0.0), lambda z, f: z + F.get(w, f["j"]) * f["x"])) - row["label"]

        # bound once as the only element, or every weight would take the errors anew
        return F.flatten(F.transform(F.array(F.transform(t["rows"], error)), lambda errors: F.zip_with(
            w, t["columns"],
            lambda own, c: own - RATE * (F.aggregate(c["f"], own * PENALTY, lambda g, f: g + F.get(errors, f["i"]) * f["x"])) / c["scale"],
        )))

    start = F.transform(table["columns"], lambda c: F.lit(0.0))
    return F.aggregate(F.array_repeat(table, EPOCHS), start, epoch)


def train(rows: DataFrame) -> Model:
    """Logistic regression on a table of ``url`` and ``label`` (1: unwanted) of at most ``MOST_LABELLED`` rows.

    Null urls and labels are left out; without rows nothing is blocked. Buckets that no labelled url has weigh nothing.
    The descent is one expression over one row, as the table is small by contract; a larger one is refused.
    """
    usable = rows.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    if usable.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    host, path = buckets(host_of(F.col("url")), path_of(F.col("url")))
    own = usable.select("url", F.col("label").cast("double").alias("label"), host.alias("h"), path.alias("p"))
    order = Window.partitionBy(F.lit(0)).orderBy("url", "label")
    numbered = own.withColumn("i", F.row_number().over(order) - 1)

    def weighed(part: str) -> Column:
        return F.transform(part, lambda bucket: F.struct(bucket.alias("b"), _size_factor(F.col(part)).alias("x")))

    intercept = F.array(F.struct(F.lit(BUCKETS).alias("b"), F.lit(1.0).alias("x")))
    entries = F.concat(intercept, weighed("h"), weighed("p"))
    features = numbered.select("i", "label", F.inline(entries)).groupBy("i", "label", "b").agg(F.sum("x").alias("x"))
    ranked = features.withColumn("j", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("b")) - 1)
    by_row = ranked.groupBy("i", "label").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("f"))
    by_column = ranked.groupBy("j", "b").agg(
        F.sort_array(F.collect_list(F.struct("i", "x"))).alias("f"), (F.sum(F.col("x") * F.col("x")) + PENALTY).alias("scale")
    )
    all_rows = by_row.agg(F.sort_array(F.collect_list(F.struct("i", "label", "f"))).alias("rows"))
    all_columns = by_column.agg(F.sort_array(F.collect_list(F.struct("j", "b", "f", "scale"))).alias("columns"))
    one = all_rows.select(F.struct("rows", all_columns.scalar().alias("columns")).alias("t"))
    fitted = one.select(F.col("t.columns.b").alias("b"), _descent(F.col("t")).alias("w")).first()
    weights = [0.0] * (BUCKETS + 1)
    for b, w in zip(fitted["b"], fitted["w"]):
        weights[b] = round(w, 6)
    if not any(weights):
        weights[BUCKETS] = -1.0
    return Model(weights)


def unwanted(model: Model, host: Column, path: Column) -> Column:
    """Probability that a url of this host and path is unwanted."""
    # one text is a constant that the planner folds, whatever the number of buckets
    weights = F.split(F.lit(",".join(map(str, model.weights[:BUCKETS]))), ",").cast("array<double>")
    sums = [F.aggregate(part, F.lit(0.0), lambda z, b: z + F.get(weights, b)) * _size_factor(part) for part in buckets(host, path)]
    return _sigmoid(sums[0] + sums[1] + model.weights[BUCKETS])


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For every row: ``page_id``, ``host``, ``path``, ``rule`` (null without one), ``verdict`` and ``score``.

    A url that is null or has no ``://`` has an empty host and path, which no rule fits; the model judges it like any. Rows
    are judged one by one: repeated rows and null ids stay, other columns don't matter, no rows give none.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = parts.withColumn("found", matching_rule(rules, host, path)).withColumn("score", unwanted(model, host, path))
    learned = F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", learned).alias("verdict"), "score"
    )
