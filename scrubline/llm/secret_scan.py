"""Secrets in texts, with credentials that consist of several parts. DataFrame functions only.

Base spans are found by three patterns. Parts that alone are too weak to report (short or generic identifiers,
bare keys, endpoints) are reported only near their complement: an identifier within SCOPE characters of
a secret, a bare key within SCOPE of an identifier, an endpoint within SCOPE of both. Parts meet in an interval
join: an interval is put into all bins of SCOPE characters it touches, parts of one document and bin are joined and
compared exactly. Spans of a kind do not overlap, so a bin holds a bounded number of parts, and a
document of any length is spread over its bins.

Offsets are code points, ends exclusive. Defined results: a null text is empty and has no spans; rows that agree in id and
text share their links; a null id is a value like others; other columns stay, names starting with _s_ are taken; no rows
give none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCOPE = 256
WINDOW = 4096  # characters of a text that are looked up at a time
BLOCK = 256  # array elements whose lengths are summed at a time

# The patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_KEPT = (r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$""",)  # holds for a match whose value has six characters
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts.
NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("user", "username", "login", "account", "client_?id"))
IDENTIFIER = rf"""(?:AKIA|ASIA|AROA)[A-Z0-9]{{4,}}|(?:{NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{{3,}}"""
KEY = r"[A-Za-z0-9+/_-]{32,}={0,2}"
KEY_KEPT = ("[0-9]", "[A-Z]", "[a-z]")  # a bare key has all of them
ENDPOINT = r"""(?:https?|ftp|jdbc|mysql|postgres(?:ql)?|rediss?|mongodb(?:\+srv)?|amqps?|ssh)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{3,}"""
KINDS = ["assign", "access", "hex", "identifier", "key", "endpoint"]
BASE = KINDS[:3]
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda, an expression would be computed anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums of an array (or what ``add`` makes of two values of at least 0), by blocks: neither copies arrays nor adds up from the front each time."""
    def upto(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), add)

    def joined(within: Column) -> Column:
        before = _once(F.transform(within, lambda block: F.element_at(block, -1)), lambda totals: F.transform(totals, lambda _, i: upto(F.slice(totals, F.lit(1), i))))
        return F.flatten(F.zip_with(within, before, lambda block, start: F.transform(block, lambda x: add(x, start))))

    def cut(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(own) / BLOCK).cast("int") - 1), lambda b: F.slice(own, b * BLOCK + 1, F.lit(BLOCK)))
        return _once(F.transform(blocks, lambda block: F.transform(block, lambda _, i: upto(F.slice(block, F.lit(1), i + 1)))), joined)

    return _once(values, cut)


def spans_of(text: Column, pattern: str, kind: str, kept: Sequence[str] = ()) -> Column:
    """Leftmost non-overlapping matches as (start, rank of the kind, end); of these, those that match each of ``kept``."""
    def spans(x: Column) -> Column:
        # the text is piece, match, piece, match, ..., piece
        gaps = F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["found"])), x["found"], lambda piece, match: F.length(piece) + F.length(match))
        out = F.zip_with(_running(gaps), x["found"], lambda end, match: F.struct(
            (end - F.length(match)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), match.alias("match")))
        for test in kept:
            out = F.filter(out, lambda s: s["match"].rlike(test))  # noqa: B023
        return F.transform(out, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(text.rlike(pattern), _once(cut, spans)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start, then kind."""
    return F.array_sort(F.concat(spans_of(text, ASSIGN, "assign", ASSIGN_KEPT), spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex")))


def weak_parts(text: Column) -> Column:
    return F.concat(spans_of(text, IDENTIFIER, "identifier"), spans_of(text, KEY, "key", KEY_KEPT), spans_of(text, ENDPOINT, "endpoint"))


def links(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """_s_key and the weak parts to report, from rows of _s_key, _s_base and _s_weak."""
    held = found.where(F.size("_s_weak") > 0).where(F.size("_s_base") + F.size("_s_weak") > 1)

    def binned(part: DataFrame, names: Sequence[str], reach: int, prefix: str) -> DataFrame:
        ranks = [KINDS.index(x) for x in names]
        bins = F.sequence(F.floor((F.col("p.start") - reach) / scope), F.floor((F.col("p.end") + reach - 1) / scope))
        return part.where(F.col("p.rank").isin(ranks)).select(F.col("_s_key").alias(f"{prefix}_key"), F.col("p").alias(prefix), F.explode(bins).alias(f"{prefix}_bin"))

    # a weak part inside a base span is that span's text, not a part of its own
    base, every = (held.select("_s_key", F.explode(c).alias("p")).distinct() for c in ("_s_base", "_s_weak"))
    inside = binned(every, KINDS[3:], 0, "w").join(binned(base, BASE, 0, "x"), (F.col("w_key") == F.col("x_key")) & (F.col("w_bin") == F.col("x_bin")))
    inside = inside.where((F.col("w.start") < F.col("x.end")) & (F.col("x.start") < F.col("w.end"))).select("w_key", "w").distinct()
    alone = every.join(inside, (F.col("_s_key") == F.col("w_key")) & (F.col("p") == F.col("w")), "left_anti")
    part = materialize(alone.unionByName(base.join(alone.select("_s_key").distinct(), "_s_key", "left_semi")), "parts")

    weak = binned(part, KINDS[3:], 0, "w")
    partner = binned(part, ["assign", "access", "hex", "identifier", "key"], scope, "x")
    near = (weak.join(partner, (F.col("w_key") == F.col("x_key")) & (F.col("w_bin") == F.col("x_bin")))
            .where((F.col("w.start") < F.col("x.end") + scope) & (F.col("x.start") < F.col("w.end") + scope)))
    is_id = F.col("x.rank").isin(KINDS.index("access"), KINDS.index("identifier"))
    seen = near.groupBy(F.col("w_key").alias("_s_key"), "w").agg(F.max(is_id).alias("has_id"), F.max(~is_id).alias("has_secret"))
    rank = F.col("w.rank")
    complete = (F.when(rank == KINDS.index("identifier"), F.col("has_secret")).when(rank == KINDS.index("key"), F.col("has_id"))
                .otherwise(F.col("has_id") & F.col("has_secret")))
    return seen.where(complete).groupBy("_s_key").agg(F.collect_list("w").alias("_s_links"))


def find_secrets(df: DataFrame, keep: Sequence[str] | None = None, text: str = "text", key: str = "doc_id", base: str = "base_spans",
                 spans: str = "spans", scope: int = SCOPE) -> DataFrame:
    """Add the base spans and all spans (base ones and linked weak parts), as arrays of (start, rank in KINDS, end).

    ``keep``: the columns to carry along, all if None.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    own = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), said))
    columns = [c for c in (df.columns if keep is None else keep) if c not in (base, spans)]
    found = materialize(df.select(*columns, own.alias("_s_key"), base_spans(said).alias("_s_base"), weak_parts(said).alias("_s_weak")), "secrets")
    linked = materialize(links(found, scope), "links")
    joined = found.join(linked.withColumnRenamed("_s_key", "_s_own"), F.col("_s_key") == F.col("_s_own"), "left")
    every = F.array_sort(F.concat("_s_base", F.coalesce("_s_links", F.expr(f"cast(array() as {SPAN})"))))
    return joined.select(*columns, F.col("_s_base").alias(base), every.alias(spans))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace what the spans cover by a mark; spans that overlap or touch become one."""
    body = F.col(text)

    def cut(windows: Column) -> Column:
        """Pieces of the text by start and end, from windows: looking up a place walks there from the beginning."""
        def piece(a: Column, b: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.floor(a / WINDOW), F.floor((b - 1) / WINDOW)), lambda k: F.substring(
                F.get(windows, k.cast("int")), (F.greatest(a - k * WINDOW, F.lit(0)) + 1).cast("int"), (F.least(b, (k + 1) * WINDOW) - F.greatest(a, k * WINDOW)).cast("int"))), "")

        def kept(x: Column) -> Column:
            # a span begins where all before it have ended: between them lies what is kept
            first = F.zip_with(x["starts"], F.slice(F.concat(F.array(F.lit(0)), x["ends"]), F.lit(1), F.size(x["starts"])), lambda start, end: F.struct(end.alias("a"), start.alias("b")))
            gaps = F.filter(first, lambda g, i: (i == 0) | (g["b"] > g["a"]))
            last = F.struct(F.element_at(x["ends"], -1).alias("a"), F.length(body).alias("b"))
            return F.array_join(F.transform(F.concat(gaps, F.array(last)), lambda g: F.when(g["b"] > g["a"], piece(g["a"], g["b"])).otherwise("")), mark)

        sorted_ = F.array_sort(F.col(spans))
        return _once(F.struct(F.transform(sorted_, lambda s: s["start"]).alias("starts"),
                              _running(F.transform(sorted_, lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("ends")), kept)

    windows = F.transform(F.sequence(F.lit(0), F.floor(F.length(body) / WINDOW)), lambda k: F.substring(body, (k * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    return found.withColumn(text, F.when(F.size(spans) > 0, _once(windows, cut)).otherwise(body))
