"""How far the sources of a language use its words differently.

Identical texts of a language are one row with the number of its copies in each
source (duplicate-text collapse); each is tokenized once, and its words count
once for every copy.  Of each language the terms that ``min_documents`` of its
documents hold are kept, V of them.  A group (language, source) and the whole
language give each kept term

    p = 1 + floor(scale * (count + 1) / (N + V))

with N the sum of its counts over kept terms, and p differs from q by
f = floor((p - q)^2 / q).  ``pair`` rows compare a source with each other source
of its language over all kept terms, ``term`` rows name the terms that a source
uses more than its language.

Pairs are evaluated where they are not constant: a term that neither source
has, or only one, adds what follows from the source alone, so only terms that
both hold are met in pairs.  A term's row is one entry per source that holds
it; a task adds up its terms and returns at most one row per pair of sources
and chunk.  No group is gathered by document, copy or source.

Defined results: null text, language and source count as empty ones; repeated
rows are copies; groups without terms take part in pairs; a language without
kept terms has pairs of value 0 and no terms; an empty table gives an empty
one.  A very long text is handled in windows, and its words are emitted as they
are counted.  Other columns are not read, so their names may clash with any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytewake.llm.common import steps
from bytewake.llm.hashed_words import per_text, separators, text_bytes, words
from bytewake.staging import Stage

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: what is no part of a term
APART = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: (term, group) counts that a task holds before it hands them on
HELD = 1_000_000
#: pairs of entries that are evaluated at once
PAIRS = 1 << 20


def groups_of(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, g) for every group that occurs; ``g`` is its number once this lies in a table."""
    return _named(docs, lang=lang, source=source).distinct().withColumn("g", F.monotonically_increasing_id())


def _named(docs: DataFrame, **columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in columns.items()])


def collapse(docs: DataFrame, groups: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, text, copies) with one row per distinct text of a language; copies are (g, n), how many in which group."""
    rows = _named(docs, lang=lang, source=source, text=text).withColumn("digest", F.unhex(F.sha2("text", 256)))
    per_source = rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = per_source.join(groups, ["lang", "source"]).groupBy("lang", "digest").agg(F.collect_list(F.struct("g", "n")).alias("copies"))
    once = rows.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    return once.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted arrays."""
    fresh = np.ones(len(keys[0]), bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


class Counts:
    """Occurrences and documents of (term, group), added up until they are handed on."""

    def __init__(self) -> None:
        self.lang: dict[int, str] = {}  # of each group
        self.terms: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, bounds = text_bytes(batch.column("text"))
        starts, ends, hashed = words(data, bounds, APART)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(per_text(starts, bounds)))
        order = np.lexsort((hashed, doc))
        at = _first(doc[order], hashed[order])
        doc, tf, term, place = doc[order][at], np.diff(np.append(at, len(order))), hashed[order][at], order[at]
        for h, i in zip(*(x.tolist() for x in np.unique(term, return_index=True))):
            if h not in self.terms:
                k = place[i]
                self.terms[h] = data[starts[k]:ends[k]].tobytes().lower()
        begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        for d, (lang, copies) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("copies").to_pylist())):
            own = slice(begin[d], begin[d + 1])
            n = own.stop - own.start
            for c in copies if n else ():
                self.lang[c["g"]] = lang
                self.parts.append((np.full(n, c["g"]), term[own], tf[own] * c["n"], np.full(n, c["n"])))
                self.size += n
                if self.size > 4 * HELD:
                    self._merge()

    def _merge(self) -> None:
        if self.parts:
            g, term, n, df = (np.concatenate(p) for p in zip(*self.parts))
            order = np.lexsort((term, g))
            g, term, n, df = g[order], term[order], n[order], df[order]
            at = _first(g, term)
            self.parts, self.size = [(g[at], term[at], np.add.reduceat(n, at), np.add.reduceat(df, at))], len(at)

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        """A row for each (language, term) with what its groups hold of it."""
        self._merge()
        if self.parts:
            g, term, n, df = self.parts[0]
            langs = sorted(set(self.lang.values()))
            known = np.array(sorted(self.lang))
            code = np.array([langs.index(self.lang[x]) for x in known.tolist()])[np.searchsorted(known, g)]
            order = np.lexsort((g, term, code))
            g, term, n, df, code = g[order], term[order], n[order], df[order], code[order]
            at = _first(code, term)
            for a in range(0, len(at), 20_000):
                rows = at[a:a + 20_000]
                end = at[a + 20_000] if a + 20_000 < len(at) else len(g)
                own = slice(rows[0], end)
                held = pa.StructArray.from_arrays([pa.array(x[own], pa.int64()) for x in (g, n, df)], names=["g", "n", "df"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([langs[c] for c in code[rows].tolist()], pa.string()),
                    pa.array([self.terms[h].decode() for h in term[rows].tolist()], pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.append(rows, end) - rows[0], pa.int32()), held),
                ], names=["lang", "term", "held"])
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        for part in steps(batch, "text"):
            counts.add(part)
            if counts.size > 4 * HELD:
                counts._merge()
            if counts.size > HELD or len(counts.terms) > HELD:
                yield from counts.hand_on()
    yield from counts.hand_on()


def kept_terms(texts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, all, held) of the terms that enough documents hold; ``held`` has (g, n) for each group with the term.

    What the tasks counted is dealt by (lang, term) once; both sums follow where it lies.
    """
    parts = texts.mapInArrow(_count, "lang string, term string, held array<struct<g: long, n: long, df: long>>")
    entries = parts.repartition("lang", "term").select("lang", "term", F.inline("held"))
    summed = entries.groupBy("lang", "term", "g").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    whole = summed.groupBy("lang", "term").agg(
        F.sum("n").alias("all"), F.sum("df").alias("df"), F.collect_list(F.struct("g", "n")).alias("held"))
    return whole.where(F.col("df") >= min_documents).drop("df")


def share(count: Column, total: Column, kept: Column, scale: int) -> Column:
    """p, exact for any count."""
    wide = (count.cast("decimal(28,0)") + F.lit(1)) * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + kept).cast("decimal(28,0)"))


def differs(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms that two sources hold add to their pair, beside what each source adds alone."""
    for batch in batches:
        entries = batch.column("held")
        k = np.diff(np.asarray(entries.offsets))
        flat = entries.flatten()
        group, p, absent = (np.asarray(flat.field(i)) for i in range(3))
        begin = np.concatenate([[0], np.cumsum(k)])
        of = np.repeat(np.arange(len(k)), k)
        until = np.concatenate([[0], np.cumsum(k[of])])  # pairs before each entry
        a = 0
        while a < len(of):
            b = max(a + 1, int(np.searchsorted(until, until[a] + PAIRS, "right")) - 1)
            left = np.repeat(np.arange(a, b), k[of[a:b]])
            right = begin[of[left]] + np.arange(len(left)) - np.repeat(until[a:b] - until[a], k[of[a:b]])
            other = left != right
            left, right = left[other], right[other]
            pa_, pb, za, zb = p[left], p[right], absent[left], absent[right]
            value = _differ(pa_, pb) - _differ(pa_, zb) - _differ(za, pb) + _differ(za, zb)
            order = np.lexsort((group[right], group[left]))
            x, y, value = group[left][order], group[right][order], value[order]
            at = _first(x, y)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[at]), pa.array(y[at]), pa.array(np.add.reduceat(value, at))], names=["a", "b", "value"])
            a = b


def audit(
    docs: DataFrame, stage: Stage, text: str = "text", lang: str = "lang", source: str = "source",
    min_documents: int = MIN_DOCUMENTS, scale: int = SCALE, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring group; see above."""
    occurring = stage(groups_of(docs, lang, source), "groups")
    kept = stage(kept_terms(collapse(docs, occurring, text, lang, source), min_documents), "kept")
    held = kept.select("lang", "term", "all", F.inline("held"))
    # one row per language, and per group, with what it counts
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("lang_total"))
    totals = held.groupBy("g").agg(F.sum("n").alias("total"))
    groups = occurring.join(totals, "g", "left").join(by_lang, "lang", "left").select(
        "lang", "source", "g", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")])
    absent = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"), scale))
    groups = stage(groups.withColumn("absent", absent), "totals")

    shares = stage(held.join(groups.drop("lang"), "g").select(
        "lang", "source", "g", "term", "absent", share(F.col("n"), F.col("total"), F.col("v"), scale).alias("p"),
        share(F.col("all"), F.col("lang_total"), F.col("v"), scale).alias("q")), "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), differs(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("absent").alias("absent_b"))
    pairs = groups.select("lang", "source", F.col("g").alias("a"), F.col("absent").alias("absent_a"), "v").join(other, "lang").where("a <> b")
    neither = differs(F.col("absent_a"), F.col("absent_b"))
    # a source has few different shares, whatever its number of terms
    values = shares.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("n"))
    alone = lambda own: values.withColumnRenamed("g", own).join(
        pairs.select("lang", "a", "b", "absent_a", "absent_b"), ["lang", own])
    first = alone("a").select("a", "b", (F.col("n") * (differs(F.col("p"), F.col("absent_b")) - neither)).alias("value"))
    second = alone("b").select("a", "b", (F.col("n") * (differs(F.col("absent_a"), F.col("p")) - neither)).alias("value"))
    met = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "absent")).alias("held"))
    both = met.where(F.size("held") > 1).select("held").mapInArrow(_both, "a long, b long, value long")
    added = first.unionByName(second).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("added"))
    value = F.when(F.col("v") > 0, F.col("v") * neither + F.coalesce("added", F.lit(0))).otherwise(0)
    pairs = pairs.join(added, ["a", "b"], "left").select("lang", "source", "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(*columns))
