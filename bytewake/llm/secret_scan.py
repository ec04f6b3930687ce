"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

Fixed patterns find assignments to names like password, access keys and long
hexadecimal strings.  Beyond them, each run of characters of a class that is at
least as long as the class's window is a candidate.  A window slides over it and
its Shannon entropy is kept up from the counts of the one character that enters
and the one that leaves; from the first to the last window that reaches the
class's limit is a span.  Candidates that an allow-list pattern matches are
suppressed; the list never touches what fixed patterns found.

Places are found natively: a pattern's matches and the gaps between them add up
to where each match begins, in code points.  Everything is DataFrame functions
within one pass over the texts, without a shuffle.

Defined results: a null text counts as an empty one and has no spans; spans of
different kinds may overlap, those of one kind never do; repeated rows get equal
results; an empty table gives an empty one; input columns named like result
columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytewake.llm.common import without

#: kind, pattern, group whose length counts, least length
FIXED = (
    ("assign", r"""(?i)(?=[past])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # whole runs only, so that short ones, of which prose is full, are no matches to begin with
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    characters: str
    window: int
    bits: float  # least entropy of a window


CLASSES = (
    CharacterClass("hex_entropy", "[0-9A-Fa-f]", 32, 3.0),
    CharacterClass("base64_entropy", "[A-Za-z0-9+/_=-]", 24, 4.1),
)

#: candidates that are no secrets: words alone, paths and names of them, counting and alphabets, placeholders;
#: repeated groups are possessive, since others need a stack frame for each round of a long candidate
ALLOWED = (
    r"^[A-Za-z]+$", r"^[a-z0-9_-]*(/[a-z0-9_-]+){2,}+/?$", r"^[a-z]+([_-][a-z]+)++$",
    r"(?i)0123456789|abcdefghij|example|placeholder|xxxxxx", r"(.)\1{7}",
)


SPANS = "array<struct<start:int,end:int,match:string>>"
#: matches that are placed in one go; an array grows by copying, so a text with many takes two levels
PLACED = 1024


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pieces(text: Column, pattern: str, found: Column) -> Column:
    """Each match of a pattern with the length of the gap before it; null without any, and the text is not looked at."""
    gaps = F.split(text, pattern, -1)
    return F.when(F.size(found) > 0, F.zip_with(
        F.slice(gaps, 1, F.size(found)), found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"))))


def places(pieces: Column) -> Column:
    """Spans (start, end, match) of matches; ``pieces`` must be a column by itself, or each chunk would search the text."""
    state = lambda kind, at, spans: F.struct(at.alias("at"), spans.alias("spans")).cast(f"struct<at:int,spans:{kind}>")

    def step(so_far: Column, piece: Column) -> Column:
        start = so_far["at"] + piece["gap"]
        end = start + F.length(piece["match"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["match"].alias("match"))
        return state(SPANS, end, F.concat(so_far["spans"], F.array(span)))

    def chunk(so_far: Column, some: Column) -> Column:
        return F.aggregate(
            some, state(SPANS, so_far["at"], F.array()), step,
            lambda done: state(f"array<{SPANS}>", done["at"], F.concat(so_far["spans"], F.array(done["spans"]))))

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PLACED).cast("int")),
        lambda i: F.slice(pieces, i * PLACED + 1, PLACED))
    placed = F.aggregate(chunks, state(f"array<{SPANS}>", F.lit(0), F.array()), chunk, lambda s: F.flatten(s["spans"]))
    return F.coalesce(F.when(pieces.isNotNull(), placed), F.array().cast(SPANS))


def long_enough(spans: Column, pattern: str, group: int, least: int) -> Column:
    measured = lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m)
    return F.filter(spans, lambda span: measured(span["match"]) >= least)


def _times_log(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(0.0)


def _count(window: Column, character: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, character, F.lit("")))


def dense_part(candidate: Column, window: int, bits: float) -> Column:
    """(first, last): places in a candidate between which windows reach the entropy; nulls where none does.

    The entropy of a window of w characters is log2(w) - sum(c * log2(c)) / w over
    the counts c of its characters; only two counts change from window to window.
    """
    kind = "struct<n:int,window:string,sum:double,first:int,last:int>"
    zero = F.struct(
        F.lit(0).alias("n"), F.lit("").alias("window"), F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    ).cast(kind)

    def step(state: Column, entering: Column) -> Column:
        full = state["n"] >= window
        leaving = F.substring(state["window"], 1, 1)
        rest = F.when(full, F.substring(state["window"], 2, window)).otherwise(state["window"])
        left, came = _count(state["window"], leaving), _count(rest, entering)
        total = (
            state["sum"] - F.when(full, _times_log(left) - _times_log(left - 1)).otherwise(0.0)
            + _times_log(came + 1) - _times_log(came)
        )
        n = state["n"] + 1
        # rounding may not decide
        reached = (n >= window) & (F.log2(F.lit(float(window))) - total / window >= bits - 1e-9)
        return F.struct(
            n.alias("n"), F.concat(rest, entering).alias("window"), total.alias("sum"),
            F.coalesce(state["first"], F.when(reached, n - window)).alias("first"),
            F.when(reached, n).otherwise(state["last"]).alias("last"),
        ).cast(kind)

    return F.aggregate(F.split(candidate, ""), zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def run_of(of: CharacterClass) -> str:
    """Pattern of a class's runs, from their first character on."""
    return f"(?<!{of.characters}){of.characters}{{{of.window},}}"


def entropy_spans(spans: Column, of: CharacterClass) -> Column:
    candidates = F.filter(
        spans, lambda span: ~F.exists(F.array(*map(F.lit, ALLOWED)), lambda allowed: F.regexp(span["match"], allowed)))
    dense = F.transform(candidates, lambda span: F.struct(
        span["start"].alias("start"), dense_part(span["match"], of.window, of.bits).alias("part")))
    return F.transform(F.filter(dense, lambda d: d["part"]["first"].isNotNull()), lambda d: F.struct(
        (d["start"] + d["part"]["first"]).alias("start"), (d["start"] + d["part"]["last"]).alias("end"), F.lit("").alias("match")))


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))).cast(SPAN)


def joined(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with ``base_spans`` and ``spans``, arrays of (start, rank, kind, end), and counts per fixed kind."""
    names = ["base_spans", "spans", *[f"n_{kind}" for kind, *_ in FIXED]]
    kept = without(docs, names)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    patterns = {kind: pattern for kind, pattern, *_ in FIXED} | {c.kind: run_of(c) for c in CLASSES}
    found = {f"_match_{kind}": matches(content, pattern) for kind, pattern in patterns.items()}
    parted = {f"_piece_{kind}": pieces(content, pattern, F.col(f"_match_{kind}")) for kind, pattern in patterns.items()}
    placed = {f"_place_{kind}": places(F.col(f"_piece_{kind}")) for kind in patterns}
    spans = {kind: long_enough(F.col(f"_place_{kind}"), pattern, group, least) for kind, pattern, group, least in FIXED}
    spans |= {c.kind: entropy_spans(F.col(f"_place_{c.kind}"), c) for c in CLASSES}
    ranked = [_ranked(F.col(f"_span_{kind}"), i, kind) for i, kind in enumerate(spans)]
    return (
        kept.withColumns(found).withColumns(parted).withColumns(placed).withColumns({f"_span_{kind}": s for kind, s in spans.items()})
        .select(
            *kept.columns, F.array_sort(F.concat(*ranked[:len(FIXED)])).alias(names[0]),
            F.array_sort(F.concat(*ranked)).alias(names[1]),
            *[F.size(f"_span_{kind}").cast("long").alias(f"n_{kind}") for kind, *_ in FIXED],
        )
    )


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
