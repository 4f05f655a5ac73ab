"""URL verdicts: rules by host suffix and path prefix, then naive Bayes over segmented host and path tokens.

Host labels are split into words by a unigram Viterbi search. The lexicon is counted over the tokens of all
URLs (with the seed words); the substrings of each distinct label are joined with it, so no lexicon is broadcast.

No URL comes with a label, so the multinomial naive Bayes starts from labelled features: a few seed words. Hosts with one are the first
labels; then a seed word has fixed odds for block that a host's prior alone outweighs, so its other words decide. The other weights are
learned from all URLs without the seed words: what stands beside them, in hosts or paths, speaks for block, and what stands in other
URLs for allow. In a second round the first model's verdicts are the labels. So a host without any seed word is blocked if its other words
are those of blocked ones, and one with a seed word is allowed if its words are those of allowed ones. Token counts and weights are exact tables, joined
to the tokens of each different (host, path shape), however many there are.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; where no
URL holds a seed word, or each does, every URL without a rule is allowed; null ids, repeated rows and other columns do not matter; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, broadcast_if_small, written


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, and paths with a prefix (written host/path)."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))

# Words of usual block list categories (adult, gambling, medicines, malware and piracy, advertising, fraud).
SEED_WORDS = tuple(
    "adult escort nude porn porno sex sexy xxx bet bets betting bingo casino casinos gambling jackpot lottery poker roulette slots cialis pharmacy pill pills steroids viagra "
    "crack hack keygen malware phishing spyware torrent torrents virus warez ads adserver banner banners clicks popup tracker loan loans payday replica scam spam".split()
)
#: Log odds for block of a seed word, and how often the lexicon counts it at least.
SEED_LOG_ODDS = math.log(10)
LEXICON_COUNT = 20

#: Labels that one task splits together.
LABELS = 2000
SMOOTHING = 0.1
#: Rounds of training: the first has the seed words' labels, the next those of the model before.
ROUNDS = 2
#: A word longer than a host's label can be is never looked up in the lexicon.
MAX_WORD = 63

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first :// and / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_columns(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits; nulls where none does."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):  # longer ones are asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern, verdict = F.when(fits, F.lit(r.pattern)).otherwise(pattern), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def _tokens(text: Column) -> Column:
    """Runs of ASCII letters, and one token for any run of digits."""
    lower = F.lower(text)
    return F.transform(F.regexp_extract_all(lower, F.lit(r"[a-z]+|[0-9]+"), F.lit(0)), lambda t: F.when(t.rlike("^[0-9]"), F.lit("0")).otherwise(t))


def lexicon(urls: DataFrame) -> DataFrame:
    """(word, n): tokens of all paths and of each distinct host's hyphenated labels, with the seed words. Labels
    without a hyphen are what is to be split, so they don't count as words."""
    paths = urls.select(F.explode(_tokens(F.col("path"))).alias("word"))
    hyphenated = F.filter(F.split("host", r"\."), lambda x: x.contains("-"))
    hosts = urls.select("host").distinct().select(F.explode(_tokens(F.concat_ws(" ", hyphenated))).alias("word"))
    counted = paths.unionByName(hosts).where("word != '0'").groupBy("word").agg(F.count("*").alias("n"))
    fixed = urls.sparkSession.createDataFrame([(w, LEXICON_COUNT) for w in SEED_WORDS], "word string, n long")
    return counted.unionByName(fixed).groupBy("word").agg(F.sum("n").alias("n"))


def segment(label: str, log_probability: dict[str, float], unknown: float) -> list[str]:
    """The likeliest split of a label. An unknown word of length l costs ``unknown`` and a further factor 10 a letter;
    ties go to the longer last word."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        found = (-math.inf, 0)
        for start in range(max(0, end - MAX_WORD), end):
            word = label[start:end]
            p = log_probability.get(word)
            score = best[start][0] + (unknown - len(word) * math.log(10) if p is None else p)
            if score > found[0]:
                found = (score, start)
        best.append(found)
    words, end = [], len(label)
    while end:
        start = best[end][1]
        words.append(label[start:end])
        end = start
    return words[::-1]


def _segment_batch(total: int):
    log_total = math.log(max(total, 1))

    def run(rows: pa.Table) -> pa.Table:
        known: dict[str, dict[str, float]] = {}
        for label, word, n in zip(*(rows.column(c).to_pylist() for c in ("label", "word", "n")), strict=True):
            found = known.setdefault(label, {})
            if n > 0:
                found[word] = math.log(n) - log_total
        words = [segment(label, found, math.log(10) - log_total) for label, found in known.items()]
        return pa.table({"label": pa.array(list(known), pa.string()), "words": pa.array(words, pa.list_(pa.string()))})

    return run


def segment_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words) of each distinct label: its substrings meet the lexicon in a join, and labels are split some LABELS at a time."""
    total = words.agg(F.sum("n")).first()[0] or 0
    batches = max(1, -(-labels.count() // LABELS))
    size = F.length("label")
    pieces = labels.withColumn("start", F.explode(F.sequence(F.lit(1), size))).withColumn("length", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), size - F.col("start") + 1)))).select("label", F.expr("substring(label, start, length)").alias("word")).distinct()
    known = pieces.join(words, "word", "left").select("label", "word", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n > 0 or word = label")
    dealt = known.withColumn("batch", F.pmod(F.xxhash64("label"), F.lit(batches)))
    return dealt.groupBy("batch").applyInArrow(_segment_batch(total), "label string, words array<string>")


@dataclass
class NaiveBayes:
    """Log odds of block against allow: a prior, a table (token, weight), and a number for each seed word. No weights: it says nothing."""

    prior: float
    weights: DataFrame | None
    seed_log_odds: float

    def scored(self, examples: DataFrame) -> DataFrame:
        """Adds ``log_odds`` to rows (host, shape, tokens, seeds), rounded so that the order of sums does not show; tokens that no training URL has say nothing."""
        if self.weights is None:
            return examples.withColumn("log_odds", F.lit(-math.inf))
        parts = examples.select("host", "shape", F.explode("tokens").alias("token")).join(broadcast_if_small(self.weights), "token")
        sums = parts.groupBy("host", "shape").agg(F.sum("weight").alias("weight"))
        whole = self.prior + F.coalesce("weight", F.lit(0.0)) + F.col("seeds") * self.seed_log_odds
        some = (F.size("tokens") > 0) | (F.col("seeds") > 0)
        return examples.join(sums, ["host", "shape"], "left").withColumn("log_odds", F.when(some, F.round(whole, 9)).otherwise(-math.inf)).drop("weight")


def _fitted(labelled: DataFrame, seed_log_odds: float) -> NaiveBayes:
    """The model of rows (tokens, n, bad)."""
    seen = labelled.agg(F.sum(F.when(F.col("bad"), F.col("n"))), F.sum(F.when(~F.col("bad"), F.col("n")))).first()
    if not (seen[0] and seen[1]):
        return NaiveBayes(-math.inf, None, seed_log_odds)
    each = labelled.select("n", "bad", F.explode("tokens").alias("token"))
    counts = written(each.groupBy("token").agg(*(F.sum(F.when(F.col("bad") == bad, F.col("n")).otherwise(0)).alias(c) for c, bad in (("block", True), ("allow", False)))), "token-counts")
    block, allow, vocabulary = (x or 0 for x in counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first())
    share = lambda c, total: F.log((F.col(c) + SMOOTHING) / (total + SMOOTHING * (vocabulary + 1)))
    weights = written(counts.select("token", (share("block", block) - share("allow", allow)).alias("weight")), "token-weights")
    return NaiveBayes(math.log(seen[0] / seen[1]), weights, seed_log_odds)


def train(examples: DataFrame, rounds: int = ROUNDS, seed_log_odds: float = SEED_LOG_ODDS) -> NaiveBayes:
    """Multinomial naive Bayes over rows (host, shape, tokens without seed words, seeds, n), each standing for n URLs."""
    model = _fitted(examples.withColumn("bad", F.col("seeds") > 0), seed_log_odds)
    for _ in range(rounds - 1):
        if model.weights is not None:
            model = _fitted(written(model.scored(examples).withColumn("bad", F.col("log_odds") > 0), "url-labels"), seed_log_odds)
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, seed_log_odds: float = SEED_LOG_ODDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) of each row of (page_id, url)."""
    bounded_batches(pages.sparkSession)
    host, path = parse_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    pattern, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    urls = written(urls.withColumns({"rule": pattern, "rule_verdict": verdict}), "urls")

    words = written(lexicon(urls), "url-lexicon")
    hosts = urls.groupBy("host").agg(F.count("*").alias("n"))
    labels = hosts.select("host", F.posexplode(_tokens(F.col("host"))).alias("place", "label"))
    split = segment_labels(labels.select("label").distinct(), words)
    by_host = labels.join(split, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("host_words"))
    segmented = written(hosts.join(by_host, "host", "left").select("host", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words")), "url-hosts")

    # A URL's path counts by its tokens alone, so that URLs of one host and shape are one example.
    shaped = urls.withColumn("shape", F.concat_ws(" ", _tokens(F.col("path"))))
    seeds = F.array(*map(F.lit, SEED_WORDS))
    kinds = shaped.groupBy("host", "shape").agg(F.count("*").alias("n")).join(segmented, "host")
    path_tokens = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split("shape", " "), lambda t: F.concat(F.lit("/"), t)))
    tokens = F.concat(F.filter("host_words", lambda w: ~F.array_contains(seeds, w)), path_tokens)
    examples = written(kinds.select("host", "shape", "n", tokens.alias("tokens"), F.size(F.filter("host_words", lambda w: F.array_contains(seeds, w))).alias("seeds")), "url-examples")
    model = train(examples.where("host != ''"), seed_log_odds=seed_log_odds)
    scores = written(model.scored(examples).select("host", "shape", "log_odds"), "url-scores")
    own = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return shaped.join(broadcast_if_small(scores), ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "log_odds")
