"""Positions of all matches of a pattern, as DataFrame expressions.

Spark returns the matches of a pattern and, by splitting, the gaps between them,
but no positions; these are running sums of both lengths, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512

BEFORE, AFTER = 24, 8  # characters of context, cut off at the neighbouring matches
SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _sums(lengths: Column, start: Column) -> Column:
    """The running sums of ``lengths`` before each entry, from ``start``."""
    step = lambda s, v: F.struct(
        (s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")
    )
    return F.aggregate(lengths, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]


def _block(lengths: str):
    return lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))


def of_kind(found: Column | str, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(found, lambda s: s["kind"] == kind)


def find(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """``df`` with an array of spans (start, end, text, before, after) per named pattern.

    A pattern comes with a cheap condition that every text with a match meets,
    or None. Matches are leftmost and do not overlap; ends are exclusive. The
    running sums work in blocks, so that a text may have very many matches.
    """
    kept, names = df.columns, list(patterns)
    empty = F.array().cast("array<string>")

    def where(condition: Column | None, value: Column) -> Column:
        return value if condition is None else F.when(condition, value).otherwise(empty)

    df = df.withColumns({
        f"_{n}_m": where(gate, F.coalesce(F.regexp_extract_all(text, F.lit(p), F.lit(0)), empty)) for n, (p, gate) in patterns.items()
    })
    # Gap and match lengths by turns: a match starts after an odd number of entries.
    df = df.withColumns({
        f"_{n}_g": F.when(F.size(f"_{n}_m") > 0, F.transform(F.split(text, p, -1), lambda x: F.struct(
            F.length(x).alias("size"), F.right(x, F.lit(BEFORE)).alias("before"), F.left(x, F.lit(AFTER)).alias("after")
        ))) for n, (p, _) in patterns.items()
    })
    df = df.withColumns({
        f"_{n}_l": F.when(F.size(f"_{n}_m") > 0, F.zip_with(
            F.slice(f"_{n}_g", F.lit(1), F.size(f"_{n}_m")), f"_{n}_m", lambda g, m: g["size"] + F.length(m)
        )) for n in names
    })
    df = df.withColumns({
        f"_{n}_b": F.when(F.size(f"_{n}_l") > 0, F.transform(
            F.sequence(F.lit(0), F.expr(f"(size(_{n}_l) - 1) div {BLOCK}").cast("int")),
            _block(f"_{n}_l"),
        )) for n in names
    })
    df = df.withColumns({
        f"_{n}_s": F.when(F.size(f"_{n}_b") > 0, F.flatten(F.zip_with(
            f"_{n}_b", _sums(F.transform(f"_{n}_b", lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)), F.lit(0)), _sums,
        ))) for n in names
    })
    spans = {
        n: F.when(F.size(f"_{n}_m") > 0, F.zip_with(
            F.zip_with(
                F.zip_with(f"_{n}_s", f"_{n}_g", lambda at, g: F.struct((at + g["size"]).alias("at"), g["before"].alias("before"))),
                F.slice(f"_{n}_g", F.lit(2), F.size(f"_{n}_m")),
                lambda a, g: F.struct(a["at"].alias("at"), a["before"].alias("before"), g["after"].alias("after")),
            ), f"_{n}_m",
            lambda c, m: F.struct(
                c["at"].alias("start"), (c["at"] + F.length(m)).alias("end"), m.alias("text"), c["before"].alias("before"),
                c["after"].alias("after"),
            ),
        )).otherwise(F.array()).cast(SPAN) for n in names
    }
    # zip_with pads the shorter side; the last gap has no match.
    spans = {n: F.filter(v, lambda s: s["text"].isNotNull()) for n, v in spans.items()}
    return df.select(*kept, *[v.alias(n) for n, v in spans.items()])


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of spans (kind, start, end) by start, then kind as listed, joined with commas."""
    order = F.array(*[F.lit(k) for k in kinds])
    rows = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")
    ))
    return F.array_join(F.transform(
        F.array_sort(rows),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    ), ",")


def labelled(spans: Column, kind: str) -> Column:
    """Spans (start, end, ...) as (kind, start, end)."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
