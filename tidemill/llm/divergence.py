"""How far the sources of a language differ in their words, in exact integers.

Terms are counted once for each (lang, source); a term is kept if enough documents of its language have it.  All that
follows works on counts, not on terms: a term's value depends on its count in the group and in the language alone, so
terms with equal counts share a cell, and a value is worked out once for each cell.

Top terms: cells with equal values are merged, the values are ranked by how many terms stand above them, and only the
values that reach the limit are expanded into terms, in UTF-8 order.

Pairs: with b the probability that a source gives a term that it lacks, the sum over all terms of abs(p1 - p2) is that
of abs(b1 - b2), corrected for the terms that one source has, by its cells, and for those that both have.  For the last
each task adds up its own terms as a matrix, so only sums for pairs of sources are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, table

#: Documents of a language that a kept term stands in at least; terms that are ranked for a group; pseudo-count; units of probability.
LEAST_DOCS, TOP, PRIOR, UNIT = 30, 50, 5, 1_000_000_000
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Different terms, and occurrences, that a task holds before it gives out its counts.
HELD, COUNTED = 500_000, 1 << 30
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; the term '' stands for the group itself."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[str, int]] = {}  # occurrences in the upper half of an integer, documents in the lower
        size = counted = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                both = np.fromiter(terms.values(), np.int64, len(terms))
                cols = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(list(terms), pa.string()), pa.array(both >> 32), pa.array(both & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                mine = held.setdefault((lang, source), {"": 0})
                before, known = len(mine), mine.get
                terms = TERM.findall(text.encode().lower().decode())  # bytes: A-Z alone change
                for term, n in Counter(terms).items():
                    mine[term] = known(term, 0) + (n << 32) + 1
                size, counted = size + len(mine) - before, counted + len(terms)
                if size > HELD or counted > COUNTED:
                    yield from given()
                    held, size, counted = {}, 0, 0
        yield from given()

    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (("lang", "lang"), ("source", "source"), (text_col, "text"))))
    counted = filled.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): occurring kept terms; ``first`` marks one row for each (lang, term)."""
    same = Window.partitionBy("lang", "term")
    seen = counts.where("term <> ''").select(
        *GROUP, "term", "n", F.sum("docs").over(same).alias("lang_docs"), F.sum("n").over(same).alias("lang_n"),
        (F.min("source").over(same) == F.col("source")).alias("first"),
    )
    return seen.where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def probability(count: str, all_counts: str, prior: int = PRIOR, unit: int = UNIT):
    """1 + floor(unit * (count + prior) / all), in decimals."""
    return F.expr(f"1 + ((cast({count} as decimal(20,0)) + {prior}) * cast({unit} as decimal(10,0))) div {all_counts}")


def group_facts(counts: DataFrame, kept: DataFrame, prior: int = PRIOR, unit: int = UNIT) -> DataFrame:
    """(lang, source, terms, whole, lang_whole, base): kept terms of the lang, denominators, probability of an absent term."""
    own = kept.groupBy(*GROUP).agg(F.sum("n").alias("own"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.count_if("first").alias("terms"))
    groups = counts.where("term = ''").select(*GROUP)
    joined = groups.join(own, GROUP, "left").join(of_lang, "lang", "left").na.fill(0, ["own", "all", "terms"])
    denominator = lambda n: (F.col(n).cast("decimal(20,0)") + F.lit(prior) * F.col("terms")).cast("decimal(25,0)")
    facts = joined.select(*GROUP, "terms", denominator("own").alias("whole"), denominator("all").alias("lang_whole"))
    return facts.withColumn("base", F.when(F.col("terms") > 0, probability("0", "nullif(whole, 0)", prior, unit)).otherwise(0))


def top_terms(kept: DataFrame, facts: DataFrame, top: int = TOP, prior: int = PRIOR, unit: int = UNIT) -> DataFrame:
    """(lang, source, item, q, value, rank): the terms by which a group exceeds its lang most."""
    counted = kept.groupBy(*GROUP, "n", "lang_n").agg(F.count("*").alias("size"))
    valued = counted.join(facts, GROUP).select(*GROUP, "n", "lang_n", "size", probability("n", "whole", prior, unit).alias("p"), probability("lang_n", "lang_whole", prior, unit).alias("q"))
    cells = valued.where("p > q").withColumn("value", F.col("p") - F.col("q"))
    merged = cells.groupBy(*GROUP, "value").agg(F.sum("size").alias("size"))
    down = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    best = merged.withColumn("nth", F.row_number().over(down)).where(F.col("nth") <= top)
    above = best.withColumn("above", F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("above") < top)
    wanted = cells.join(above.select(*GROUP, "value", "above"), [*GROUP, "value"]).select(*GROUP, "n", "lang_n", "q", "value", "above")
    in_order = Window.partitionBy(*GROUP, "value").orderBy("term")
    terms = kept.join(wanted, [*GROUP, "n", "lang_n"]).withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= top)
    ranked = terms.withColumn("rank", (F.col("above") + F.col("nth")).cast("int")).where(F.col("rank") <= top)
    return ranked.select(*GROUP, F.col("term").alias("item"), "value", "rank")


def _common_parts(rows: DataFrame) -> DataFrame:
    """(lang, source, item, part), source < item: corrections for terms that both have.  ``rows``: a lang, and what its sources give a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            lists = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            each = lists.flatten()
            source = np.array(each.field(0).to_pylist(), object)
            p, base = each.field(1).to_numpy(), each.field(2).to_numpy()
            for lang in set(langs.tolist()):
                mine = np.flatnonzero(langs[row] == lang)
                names, code = np.unique(source[mine], return_inverse=True)
                _, term = np.unique(row[mine], return_inverse=True)
                absent = np.zeros(len(names), np.int64)
                absent[code] = base[mine]
                given = np.tile(absent, (term.max() + 1, 1))
                given[term, code] = p[mine]
                for a in range(len(names) - 1):
                    x, y = given[:, a, None], given[:, a + 1 :]
                    both = np.abs(x - y) - np.abs(x - absent[a + 1 :]) - np.abs(absent[a] - y) + np.abs(absent[a] - absent[a + 1 :])
                    for other, part in zip(names[a + 1 :], both.sum(0).tolist()):
                        key = (lang, names[a], other)
                        sums[key] = sums.get(key, 0) + part
        cols = [*map(list, zip(*sums)), list(sums.values())] if sums else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string()] * 3 + [pa.int64()])], ["lang", "source", "item", "part"])

    return rows.mapInArrow(run, "lang string, source string, item string, part long")


def source_pairs(kept: DataFrame, facts: DataFrame, prior: int = PRIOR, unit: int = UNIT) -> DataFrame:
    """(lang, source, item, value, rank): the distance of each other source of the lang, summed over all kept terms."""
    other = facts.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    pairs = facts.select(*GROUP, "terms", "whole", "base").join(other, "lang").where("source <> item")
    apart = F.abs(F.col("base") - F.col("item_base"))
    cells = kept.groupBy(*GROUP, "n").agg(F.count("*").alias("size"))
    own = cells.join(pairs, GROUP).select(*GROUP, "item", (F.col("size") * (F.abs(probability("n", "whole", prior, unit) - F.col("item_base")) - apart)).alias("part"))
    given = kept.join(facts, GROUP).select("lang", "term", F.struct("source", probability("n", "whole", prior, unit).alias("p"), "base").alias("each"))
    common = _common_parts(given.groupBy("lang", "term").agg(F.collect_list("each").alias("each")).select("lang", "each"))  # a row for each source at most
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part")
    start = pairs.select(*GROUP, "item", (F.col("terms") * apart).alias("part"))
    parts = start.unionByName(own).unionByName(turned(own)).unionByName(common).unionByName(turned(common))
    summed = parts.groupBy(*GROUP, "item").agg(F.sum("part").alias("value"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, prior: int = PRIOR, unit: int = UNIT, text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows of ``source_pairs`` and ``term`` rows of ``top_terms``.

    Each row of ``docs`` counts as a document, repeated ones too.  Null lang, source and text count as ''.  Very long
    texts are read whole.  Ties go to the item that is smaller in UTF-8.  A lang without kept terms has pairs of value
    0; a lang with one source has none.  Other columns are not read; an empty table gives no rows.
    """
    counts = materialise(term_counts(docs, text_col), "term-counts")
    kept = materialise(kept_counts(counts, least_docs), "kept-terms")
    facts = materialise(group_facts(counts, kept, prior, unit), "group-facts")
    shown = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return shown(source_pairs(kept, facts, prior, unit), "pair").unionByName(shown(top_terms(kept, facts, top, prior, unit), "term"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of all sources of all documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), v AS (
  SELECT l.lang, count(term) AS v, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, any_value(v.v) AS v, any_value(v.n) AS lang_n, coalesce(sum(c.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) s JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY s.lang, s.source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 5)) // (g.lang_n + 5 * g.v) AS q
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY a.lang, a.source, b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
