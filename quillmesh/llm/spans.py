"""What the span-finding operators (personal data, secrets) share: column type, digests, replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code-point offsets, end exclusive; origin is 'base' for a pattern's match and 'crf' for a tagged one.
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,origin:string>>"


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["origin"] == "base")


def n_base(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: (s["origin"] == "base") & (s["kind"] == kind))).cast("long")


def ordered(found: list[tuple[str, int, int, str]], kinds: list[str]) -> list[dict]:
    """Spans by start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": s, "end": e, "origin": o} for k, s, e, o in sorted(found, key=lambda x: (x[1], rank[x[0]], x[2]))]


def free(found: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Those of found (..., start, end) that overlap none of taken: one walk along both in order."""
    out, high, k = [], 0, 0
    taken = sorted(taken)
    for x in sorted(found, key=lambda x: x[-2]):
        while k < len(taken) and taken[k][0] < x[-1]:
            high = max(high, taken[k][1])
            k += 1
        if high <= x[-2]:
            out.append(x)
    return out


def cut_out(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with every maximal stretch of the spans replaced by mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
