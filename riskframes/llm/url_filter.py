"""URL filters: rules by host and path, and for all other addresses a score of the words in them.

Names such as ``freebets`` are split into words by a unigram Viterbi search: each split costs the sum of its words'
negative log probabilities; a string that is no known word costs more with each letter, whatever its length. Half of a word's probability
comes from the phrases and common words below, half from its share of all words of a corpus (``word_counts``: counted over all
documents, the ``most`` commonest kept), so the model is the same at every size. Multinomial naive Bayes, trained here on labelled phrases,
scores the words of host and path; words that it doesn't know say nothing.

Inputs: null addresses and those without ``://`` have an empty host and path; no rule fits and no word is known, so they are
allowed. Very long addresses are read whole, in time proportional to their length. Extra columns are ignored; those named in ``keep`` stay, a clash
with an output name is an error. Equal rows get equal results. An empty table gives no rows; a corpus without words adds none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import frugal

#: Phrases of names that are to be blocked (gambling, adult, drugs, scams, malware, piracy, trackers, link spam) and of ordinary ones, and common words.
BLOCKED_PHRASES = """online casino bonus|casino royal games|casino win big|poker room|texas holdem poker|slots jackpot|free slots spins|roulette live|blackjack table|sports betting odds|bet tips|
free bets today|football bets|bingo jackpot|lottery win numbers|gambling wins|wager sportsbook|adult video|adult chat|adult dating tonight|porn tube|free porn movies|xxx movies|xxx adult|
sex cams live|sex chat rooms|nude girls|naked models|hot escorts|escort agency|erotic stories|hookup tonight|milf tube|webcam strip|fetish club|cheap viagra|cialis generic pills|
cheap pills online|cheap meds pharmacy|no prescription pharmacy|weight loss pills|diet pills miracle|steroids buy online|replica watches|replica handbags outlet|fake rolex|
payday loans fast|instant cash loans|bad credit loan|get rich quick|earn money fast|make money online|free money now|forex signals profit|crypto doubler|bitcoin giveaway|
free iphone winner|claim prize now|win prizes|free gift card|survey rewards|miracle cure|malware download|trojan dropper|virus scan alert|phishing login verify|account suspended verify|
keylogger tool|botnet panel|exploit kit|warez download|crack keygen|serial keys free|torrent warez|nulled scripts|pirate movies|hack cheats|ads tracker|ad server|ads network click|
click track|popunder ads|pop ads|banner ads track|tracking pixel|affiliate clicks|link farm|link spam|buy backlinks|seo links cheap|spam mailer|spam farm|bulk email spam|article spinner|
traffic bot|fake followers buy|doorway pages""".replace("\n", "").split("|")
ALLOWED_PHRASES = """daily news|world news today|local news weather|science journal|science daily|travel guide|travel diary|food recipes|cooking school|city library|public library|school district|
high school|university research|college admissions|open source project|data science course|art museum|art gallery|history archive|history of art|health care|health clinic|hospital center|
doctor advice|city council|state government|public records|weather forecast|sports news|football club|tennis club|music review|music school|book review|book store|film review|film festival|
photo gallery|garden tips|home garden|home page|help center|support forum|user forum|wiki page|online shop|shop local|furniture store|web design|software company|cloud computing|
developer docs|code review|law journal|law firm|legal advice|medical journal|nursing school|free software|company profile|about us|contact us|jobs careers|car reviews|auto repair|
real estate|hotel booking|flight search|train times|bus schedule|bank branch|savings account|insurance quotes|tax office|small business|chess club|video tutorial|video lessons|game reviews|
board games|kids games|live stream|live music|church community|charity fund|animal rescue|pet care|bird watching|nature park|hiking trails|bike shop|running club|fitness training|
language lessons|math help|physics notes|chemistry lab|space center|engineering blog|design studio|fashion week|magazine issue|radio station|theater tickets|event calendar|
farm market|farm fresh eggs|track and field|mail order|click here|free trial|win the game|cheap flights|adult education|adult learning|cash flow|credit union|loan calculator""".replace("\n", "").split("|")
COMMON_WORDS = """the of and to in is for on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has search free but
our one other do no information time they site he up may what which their news out use any there see only so his when contact here business who web also now help get view online
first am been would how were services some these click its like service than find price date back top people my had list name just over state year day into email two health world
next used go work last most products music buy data make them should product system post her city add policy number such please available copyright support message after best
software then good video well where info rights public books high school through each links she review years order very privacy book items company read group need many user""".split()
UNKNOWN_MASS, LETTERS = 1e6, 10.0
PARTS = 8
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_ADDRESS = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
_LETTERS = re.compile(r"[a-z]+")


class Words:
    """Word probabilities, and the cheapest split of a name."""

    def __init__(self, corpus: dict[str, int] | None = None) -> None:
        own = Counter({w: 2000 // (k + 2) + 1 for k, w in reversed(list(enumerate(COMMON_WORDS)))})
        for phrase in BLOCKED_PHRASES + ALLOWED_PHRASES:
            for w in phrase.split():
                own[w] += 20
        share: Counter[str] = Counter()
        for counts in (own, corpus or {}):
            total = sum(counts.values())
            for w, c in counts.items():
                share[w] += c / total / 2
        self.cost = {w: min(-math.log(p), self.unknown(len(w))) for w, p in share.items()}
        self.longest = max(map(len, self.cost))

    @staticmethod
    def unknown(size: int) -> float:
        return math.log(UNKNOWN_MASS) + size * math.log(LETTERS)

    def split(self, name: str) -> tuple[str, ...]:
        """The words of the cheapest split; ties go to the longer last word.

        A word that isn't known costs the same for each more letter, so the best one that ends at a place is the best of the place before
        with a letter more, or begins there: time is that of the known words, however long the name.
        """
        letter = math.log(LETTERS)
        best, last = [0.0], [0]
        open_cost, open_start = math.inf, 0  # the cheapest split whose last word isn't known
        for end in range(1, len(name) + 1):
            open_cost += letter
            begun = best[end - 1] + self.unknown(1)
            if begun < open_cost:
                open_cost, open_start = begun, end - 1
            cost, start = open_cost, open_start
            for i in range(max(0, end - self.longest), end):
                known = self.cost.get(name[i:end])
                if known is not None and (best[i] + known, i) < (cost, start):
                    cost, start = best[i] + known, i
            best.append(cost)
            last.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[last[end] : end])
            end = last[end]
        return tuple(reversed(words))


class NaiveBayes:
    """Multinomial naive Bayes with add-one counts over the words of the labelled phrases."""

    def __init__(self, blocked: list[str] = BLOCKED_PHRASES, allowed: list[str] = ALLOWED_PHRASES, prior: float = 0.3) -> None:
        counts = [Counter(w for p in phrases for w in p.split()) for phrases in (blocked, allowed)]
        known = set(counts[0]) | set(counts[1])
        sums = [sum(c.values()) + len(known) for c in counts]
        self.odds = {w: math.log((counts[0][w] + 1) / sums[0]) - math.log((counts[1][w] + 1) / sums[1]) for w in known}
        self.prior = math.log(prior / (1 - prior))

    def score(self, words: list[str]) -> float:
        """Log odds of being blocked."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


class Scorer:
    """Scores of addresses by the words of host and path."""

    def __init__(self, corpus: dict[str, int] | None = None, bayes: NaiveBayes | None = None) -> None:
        self.words, self.bayes = Words(corpus), bayes or NaiveBayes()
        self.name_words = lru_cache(200_000)(self.words.split)

    def score(self, host: str, path: str) -> float:
        """Log odds of being blocked."""
        words: list[str] = []
        for name in _LETTERS.findall(host.rpartition(".")[0] or host) + _LETTERS.findall(path.lower()):
            words += self.name_words(name)
        return self.bayes.score(words)


def word_counts(docs: DataFrame, text: str = "text", most: int = 20_000) -> dict[str, int]:
    """The ``most`` commonest words of letters a to z in all of ``docs``, with their counts; ties in order of the word.

    The commonest of each of ``PARTS`` parts of the words are found first, so the driver gets ``PARTS * most`` rows at most, however many tasks there are.
    """
    words = docs.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word")).filter("word != ''")
    counts = words.groupBy("word").agg(F.count("*").alias("c")).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    first = Window.partitionBy("part").orderBy(F.desc("c"), "word")
    counts = counts.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most).select("word", "c")
    return {r["word"]: r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(most).collect()}


def parse(url: str | None) -> tuple[str, str]:
    """Host with A-Z lowered, and path."""
    found = _ADDRESS.match(url) if url else None
    if not found:
        return "", ""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), found[1]), found[2]


def rule_table(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    """By host: (path, rule, verdict), the longest first."""
    out: dict[str, list] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    return {h: sorted(r, key=lambda x: -len(x[0])) for h, r in out.items()}


def fitting_rule(host: str, path: str, table: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule for the host or a domain above it whose path the address starts with."""
    found, at = None, 0
    while True:
        for start, rule, verdict in table.get(host[at:], ()):
            if path.startswith(start) and (found is None or len(rule) > len(found[0])):
                found = rule, verdict
        at = host.find(".", at) + 1
        if not at:
            return found


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, keep: tuple[str, ...] = (), corpus: dict[str, int] | None = None) -> DataFrame:
    """(key, kept columns, host, path, rule, verdict) of every address; ``corpus``: counts of words, for splitting names."""
    rows = pages.select(key, *keep, url)
    extra = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    schema = T.StructType([*rows.schema.fields[:-1], *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scorer = rule_table(rules), Scorer(corpus)
        for batch in batches:
            hosts, paths, which, verdicts = [], [], [], []
            for address in batch.column(batch.num_columns - 1).to_pylist():
                host, path = parse(address)
                rule = fitting_rule(host, path, table)
                hosts.append(host)
                paths.append(path)
                which.append(rule and rule[0])
                verdicts.append(rule[1] if rule else "block" if scorer.score(host, path) > 0 else "allow")
            arrays = [*batch.columns[:-1], *(pa.array(x, pa.string()) for x in (hosts, paths, which, verdicts))]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return rows.mapInArrow(frugal(run), schema)
