"""URL filters: rules first, then a character language-model ratio.

Two variable-order Markov models are counted, one over accepted URLs and one over rejected ones, from all strings of up
to ``order + 1`` bytes; a context that wasn't seen falls back to a shorter one (Witten-Bell smoothing).  A URL's score
is the difference of its log-likelihoods divided by its bytes; the threshold is calibrated on decided URLs that weren't
counted.

Counts stay in tables, so a model grows with its examples and no process holds it.  Each different string of a URL is
joined to its counts and to its contexts' totals once, from the shortest strings up.  URLs are dealt to chunks by hash;
the terms of a chunk's strings are joined to it, and a task that scores URLs holds the terms of one chunk at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, partitions, table

#: For ``fit_urls`` alone, the model on the driver: a string is kept if it is at least 1 in so many of its length.
SHARE = 20_000
#: URLs of a chunk on average; a task holds the terms of one chunk's strings.
CHUNK = 2_000
ORDER = 4
#: Decided URLs of which one in so many (by hash) calibrates instead of being counted.
CALIBRATE = 5
#: Steps of the score histogram, which spans -8 to 8.
STEPS = 4096
BEGIN, END = b"\x02", b"\x03"


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, and behind its first slash a path; it fits that host, its subdomains and longer paths."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, ruled): the longest fitting rule's text and verdict, or nulls."""
    host, path = host_and_path(F.col(url_col))
    found = pages.select("page_id", F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return found.select("*", rule.alias("rule"), verdict.alias("ruled"))


@dataclass
class Markov:
    """Counts of kept strings, and for each kept context its total and number of different next bytes."""

    grams: dict[bytes, int] = field(default_factory=dict)
    total: dict[bytes, int] = field(default_factory=dict)
    kinds: dict[bytes, int] = field(default_factory=dict)
    order: int = ORDER

    @classmethod
    def of(cls, grams: dict[bytes, int], order: int = ORDER) -> Markov:
        model = cls(grams, {}, {}, order)
        for g, n in grams.items():
            model.total[g[:-1]] = model.total.get(g[:-1], 0) + n
            model.kinds[g[:-1]] = model.kinds.get(g[:-1], 0) + 1
        return model

    def probability(self, context: bytes, byte: bytes) -> float:
        """Of the next byte: each longer context mixes its own counts with what the shorter ones say."""
        p = 1 / 256
        for k in range(len(context), -1, -1):
            c = context[k:]
            if n := self.total.get(c):
                t = self.kinds[c]
                p = (self.grams.get(c + byte, 0) + t * p) / (n + t)
        return p


class Ratio:
    """Length-normalised log-likelihood difference of two models, with their per-context terms remembered."""

    def __init__(self, accepted: Markov, rejected: Markov):
        self.accepted, self.rejected, self.order = accepted, rejected, accepted.order
        self.known: dict[bytes, float] = {}

    def score(self, url: str | None) -> float:
        """Above zero: more like the accepted URLs.  Null counts as empty."""
        text = BEGIN * self.order + (url or "").encode() + END
        known, total, k = self.known, 0.0, self.order
        for i in range(k, len(text)):
            gram = text[i - k : i + 1]
            term = known.get(gram)
            if term is None:
                c, b = gram[:-1], gram[-1:]
                term = math.log(self.accepted.probability(c, b) / self.rejected.probability(c, b))
                if len(known) < 500_000:
                    known[gram] = term
            total += term
        return total / (len(text) - k)


def _grams(order: int):
    """Partial counts of all strings of 1 to order + 1 bytes that end in a URL's bytes, for rows (accepted, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def full() -> pa.RecordBatch:
            keys = list(counts)
            cols = [pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.binary()), pa.array([counts[k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["accepted", "gram", "n"])

        for b in batches:
            for accepted, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = BEGIN * order + (url or "").encode() + END
                for k in range(order + 1):
                    counts.update([(accepted, text[i - k : i + 1]) for i in range(order, len(text))])
            if len(counts) > 300_000:
                yield full()
                counts = Counter()
        yield full()

    return run


@dataclass
class UrlModel:
    """Two models and a threshold; without examples of both kinds ``ratio`` is None and ``default`` is the verdict."""

    ratio: Ratio | None
    threshold: float = 0.0
    default: str = "allow"


def _scored(decided: DataFrame, ratio: Ratio) -> DataFrame:
    """(accepted, step): the histogram step of each URL's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = [min(STEPS - 1, max(0, math.floor((ratio.score(u) + 8) * STEPS / 16))) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(steps, pa.int32())], ["accepted", "step"])

    return decided.select("accepted", "url").mapInArrow(run, "accepted boolean, step int")


def _calibration() -> Column:
    """Zero for the decided URLs that calibrate."""
    return F.pmod(F.xxhash64("url"), F.lit(CALIBRATE))


def count_grams(decided: DataFrame, order: int = ORDER) -> DataFrame:
    """(accepted, gram, n): all strings of 1 to ``order + 1`` bytes of the decided URLs that don't calibrate."""
    counted = decided.where(_calibration() != 0).select("accepted", "url").mapInArrow(_grams(order), "accepted boolean, gram binary, n long")
    return materialise(counted.groupBy("accepted", "gram").agg(F.sum("n").alias("n")), "grams")


def best_threshold(steps: dict[bool, list[int]]) -> float:
    """The score from which on to accept, given both kinds' histograms: the middle of those with the largest mean of
    the two kinds' shares of right verdicts; zero if a kind is missing."""
    good, bad = (sum(steps[k]) for k in (True, False))
    if not good or not bad:
        return 0.0
    best, at, right = -1.0, [0], [good / good, 0.0]
    for k in range(STEPS + 1):  # accept from step k on
        mean = (right[0] + right[1]) / 2
        if mean > best + 1e-12:
            best, at = mean, [k]
        elif mean > best - 1e-12:
            at.append(k)
        if k < STEPS:
            right = [right[0] - steps[True][k] / good, right[1] + steps[False][k] / bad]
    return at[len(at) // 2] * 16 / STEPS - 8


def _histogram(scored: DataFrame) -> dict[bool, list[int]]:
    steps = {k: [0] * STEPS for k in (True, False)}
    for r in scored.groupBy("accepted", "step").count().collect():  # at most 2 * STEPS rows
        steps[r.accepted][r.step] = r["count"]
    return steps


def fit_urls(decided: DataFrame, order: int = ORDER, share: int = SHARE) -> UrlModel:
    """A model that fits one process, over ``decided`` (accepted boolean, url); ``judge_urls`` doesn't use it.

    Strings under 1 in ``share`` of their length are dropped.  All decided URLs are counted but one in CALIBRATE,
    which are scored for the threshold.  If only one kind was counted, its verdict is given to all; if none, all are
    allowed.
    """
    grams = count_grams(decided, order)
    size = grams.groupBy("accepted", F.octet_length("gram").alias("length")).agg(F.sum("n").alias("all"))  # at most 2 * (order + 1) rows
    kept = grams.withColumn("length", F.octet_length("gram")).join(F.broadcast(size), ["accepted", "length"]).where(F.col("n") * share >= F.col("all"))
    models: dict[bool, dict[bytes, int]] = {True: {}, False: {}}
    for r in kept.select("accepted", "gram", "n").collect():  # at most 2 * (order + 1) * share rows
        models[r.accepted][bytes(r.gram)] = r.n
    if not models[True] or not models[False]:
        return UrlModel(None, default="block" if models[False] else "allow")
    ratio = Ratio(Markov.of(models[True], order), Markov.of(models[False], order))
    return UrlModel(ratio, best_threshold(_histogram(_scored(decided.where(_calibration() == 0), ratio))))


def log_ratios(needed: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, term) of the different strings ``needed`` (gram, of ``order + 1`` bytes): the log of the ratio of both
    models' probabilities of the last byte.  ``grams``: see ``count_grams``.

    A probability of length k + 1 mixes the counts of its string with the probability of the string without its first
    byte, so each length is joined to the one before.  A string has at most 256 others with its context or its end, so
    no key of a join is hot.
    """
    kinds = (("accepted", F.col("accepted")), ("rejected", ~F.col("accepted")))
    counts = materialise(grams.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k, c in kinds]), "counts")
    sums = [F.sum(f"n_{k}").alias(f"all_{k}") for k, _ in kinds] + [F.count_if(F.col(f"n_{k}") > 0).alias(f"kinds_{k}") for k, _ in kinds]
    contexts = materialise(counts.groupBy(F.expr("substring(gram, 1, octet_length(gram) - 1)").alias("context")).agg(*sums), "contexts")
    wanted = [needed]
    for k in range(order, 0, -1):
        wanted.insert(0, wanted[0].select(F.expr(f"substring(gram, 2, {k})").alias("gram")).distinct())
    shorter = None
    for k, rows in enumerate(wanted):
        rows = rows.withColumn("context", F.expr(f"substring(gram, 1, {k})"))
        if shorter is None:
            rows = rows.withColumns({f"p_{kind}": F.lit(1 / 256) for kind, _ in kinds})
        else:
            rows = rows.withColumn("end", F.expr(f"substring(gram, 2, {k})")).join(shorter.withColumnRenamed("gram", "end"), "end").drop("end")
        rows = rows.join(counts.where(F.octet_length("gram") == k + 1), "gram", "left").join(contexts.where(F.octet_length("context") == k), "context", "left")
        mixed = {}
        for kind, _ in kinds:
            n, whole, t, p = F.coalesce(f"n_{kind}", F.lit(0)), F.col(f"all_{kind}"), F.col(f"kinds_{kind}"), F.col(f"p_{kind}")
            mixed[f"p_{kind}"] = F.when(whole > 0, (n + t * p) / (whole + t)).otherwise(p)
        shorter = rows.withColumns(mixed).select("gram", *mixed)
    return shorter.select("gram", F.log(F.col("p_accepted") / F.col("p_rejected")).alias("term"))


def _windows(url: str | None, order: int) -> list[bytes]:
    """The string of ``order + 1`` bytes at each byte of a URL and at its end.  Null counts as empty."""
    text = BEGIN * order + (url or "").encode() + END
    return [text[i - order : i + 1] for i in range(order, len(text))]


def _chunk_grams(order: int):
    """(chunk, gram), each once, of rows (chunk, url) that come by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, set()

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now] * len(found), pa.int64()), pa.array(list(found), pa.binary())], ["chunk", "gram"])

        for b in batches:
            for chunk, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if chunk != now:
                    if found:
                        yield full()
                    now, found = chunk, set()
                found.update(_windows(url, order))
        if found:
            yield full()

    return run


def _chunk_scores(order: int):
    """(row, score) of rows (chunk, is_url, gram, term, row, url) that come by chunk, the terms of a chunk before its URLs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, terms = None, {}
        for b in batches:
            rows, scores = [], []
            for chunk, is_url, gram, term, row, url in zip(*(c.to_pylist() for c in b.columns)):
                if chunk != now:
                    now, terms = chunk, {}
                if is_url:
                    of = _windows(url, order)
                    rows.append(row)
                    scores.append(sum(terms[g] for g in of) / len(of))
                else:
                    terms[gram] = term
            yield pa.RecordBatch.from_arrays([pa.array(rows, ROW), pa.array(scores, pa.float64())], ["row", "score"])

    return run


#: What goes through the scoring task with each URL.
ROW = pa.struct([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("ruled", pa.string()), ("calibrates", pa.bool_())])
ROW_SCHEMA = "struct<page_id: bigint, host: string, path: string, rule: string, ruled: string, calibrates: boolean>"


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row.

    URLs that a rule decides are the examples: allowed ones accepted, blocked ones rejected; the method decides the
    others by their score (null where no model could be counted: if only one kind was counted, its verdict is given to
    all; if none, all are allowed).  Null URLs have empty host and path and are scored as empty text.  Repeated rows
    stay repeated; very long URLs are counted and scored whole; other columns are not read; an empty table gives no rows.
    """
    ruled = with_rule(pages, rules).withColumn("page_id", F.col("page_id").cast("long"))
    ruled = materialise(ruled.withColumn("calibrates", F.col("ruled").isNotNull() & (_calibration() == 0)), "urls")
    grams = count_grams(ruled.where("ruled is not null").select((F.col("ruled") == "allow").alias("accepted"), "url"), order)
    counted = {r.accepted for r in grams.select("accepted").distinct().collect()}  # at most two rows
    if len(counted) < 2:
        default = "block" if counted == {False} else "allow"
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    spark = pages.sparkSession
    n, chunks = partitions(spark), max(1, ruled.count() // chunk)
    urls = ruled.withColumn("chunk", F.pmod(F.xxhash64("page_id", "url"), F.lit(chunks)))
    needed = urls.select("chunk", "url").repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(_chunk_grams(order), "chunk long, gram binary")
    needed = materialise(needed, "chunk-grams")
    terms = log_ratios(materialise(needed.select("gram").distinct(), "url-grams"), grams, order)
    given = needed.join(terms, "gram").select("chunk", F.lit(False).alias("is_url"), "gram", "term", F.lit(None).cast(ROW_SCHEMA).alias("row"), F.lit(None).cast("string").alias("url"))
    asked = urls.select("chunk", F.lit(True).alias("is_url"), F.lit(None).cast("binary").alias("gram"), F.lit(None).cast("double").alias("term"), F.struct(*[f.name for f in ROW]).alias("row"), "url")
    both = given.unionByName(asked).repartition(n, "chunk").sortWithinPartitions("chunk", "is_url")
    scored = materialise(both.mapInArrow(_chunk_scores(order), f"row {ROW_SCHEMA}, score double").select("row.*", "score"), "scores")
    step = F.least(F.lit(STEPS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + 8) * STEPS / 16))).cast("int").alias("step")
    threshold = best_threshold(_histogram(scored.where("calibrates").select((F.col("ruled") == "allow").alias("accepted"), step)))
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return judge_urls(table(spark, sf_dir, "pages"))
