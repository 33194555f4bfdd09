"""Secrets in texts: fixed patterns, and strings whose characters are too evenly spread to be words.

Candidates of the second kind are long runs of one character class. A window slides over a run and
carries the count of every character of the class along, packed in a string. When a character enters
or leaves, only its own count is read and written, and the sum of ``c log c`` changes by two terms. A
run is reported from the first to the last window above the threshold of its class, unless the
allow-list knows its shape, or next to nothing is left of it without a placeholder's words.

Everything is built from SQL functions on the row of the text; nothing is shuffled. Defined cases: a
null or empty text has no spans; repeated rows and null ids are answered row by row; an empty table
gives an empty result; other columns are not read. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import running

# Fixed patterns, in the order in which kinds with the same start are listed. Of ``assign`` the value,
# of the others the whole match has a smallest length; shorter matches are dropped, not looked past.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
# Runs match greedily, so a smallest length inside the pattern selects the same runs.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
_HEX_DIGITS = "0123456789ABCDEFabcdef"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Character class -> (pattern of its runs, least entropy of a window in bits per character, its characters).
CLASSES = {
    "entropy_hex": (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", 3.0, _HEX_DIGITS),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 3.8, _BASE64),
}
# Shapes that are no secrets however evenly their characters are spread.
ALLOWED = {
    "one case, no digit": r"^(?:[A-Z]?[a-z+/_=-]+|[A-Z+/_=-]+)$",
    "number": r"^[0-9_=+/-]+$",
    "universally unique id": r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    "words joined by marks": r"^(?:[A-Za-z]+|[0-9]+)(?:[+/_=-]+(?:[A-Za-z]+|[0-9]+))+$",
}
# Words that mark a placeholder. They only excuse a run that is shorter than a window without them.
PLACEHOLDER = r"(?i:example|placeholder|x{6,}|0123456789|abcdefghij)"
KINDS = ["assign", "access", "hex", *CLASSES]


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def found(text: Column, pattern: str) -> Column:
    """``[(start, match)]`` of the leftmost matches: lengths of what lies between them, added up."""
    between = F.split(text, pattern)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    row = "struct<start:int,match:string>"

    def step(at, x):
        start = at + F.length(x["between"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        return end, F.when(x["match"].isNotNull(), F.struct(start.alias("start"), x["match"].alias("match")))

    zipped = F.arrays_zip(between.alias("between"), matches.alias("match"))
    return F.when(text.rlike(pattern), running(zipped, row, step)).otherwise(_empty(row))


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")
    )


def _whole(kind: str, matches: Column) -> Column:
    return F.transform(matches, lambda m: _span(kind, m["start"], m["start"] + F.length(m["match"])))


def high_windows(run: Column, least: float, alphabet: str, window: int = WINDOW) -> Column:
    """``(first, last)``: where the first window of ``run`` with entropy ``least`` or more begins and the last ends.

    ``sum`` is the sum of ``c log2 c`` over the counts ``c`` in the window; the entropy is
    ``log2(window) - sum / window``. ``counts`` holds a letter per character of ``alphabet``, A for none.
    """
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    zero = ord("A")

    def slide(chars):
        def change(a, place, by):
            """``counts`` and ``sum`` after the character of ``place`` entered (1) or left (-1)."""
            slot = F.instr(F.lit(alphabet), F.get(chars, place))
            count = F.ascii(F.substr(a["counts"], slot, F.lit(1))) - zero
            counts = F.overlay(a["counts"], F.char(count + (zero + by)), slot, F.lit(1))
            return counts, a["sum"] + F.get(weights, count + by) - F.get(weights, count)

        def step(a, j):
            # Two steps per character: first the one that falls out, then the one that comes in.
            i = F.shiftright(j, 1)
            leaves = (j % 2 == 0) & (i > window)
            fewer, less = change(a, i - window - 1, -1)
            more, sum_ = change(a, i - 1, 1)
            entered = j % 2 == 1
            total = F.when(entered, sum_).when(leaves, less).otherwise(a["sum"])
            high = entered & (i >= window) & (F.lit(math.log2(window)) - sum_ / window >= F.lit(least - 1e-9))
            return F.struct(
                F.when(entered, more).when(leaves, fewer).otherwise(a["counts"]).alias("counts"),
                total.alias("sum"),
                F.when(high, F.coalesce(a["first"], i - window)).otherwise(a["first"]).alias("first"),
                F.when(high, i).otherwise(a["last"]).alias("last"),
            )

        nowhere = F.lit(None).cast("int")
        start = F.struct(
            F.lit("A" * len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
            nowhere.alias("first"), nowhere.alias("last"),
        )
        steps = F.sequence(F.lit(2), 2 * F.size(chars) + 1)
        return F.aggregate(steps, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    chars = F.split(run, "")
    return F.get(F.transform(F.array(chars), slide), 0)


def _uneven(kind: str, text: Column) -> Column:
    pattern, least, alphabet = CLASSES[kind]
    allowed = "|".join(f"(?:{shape})" for shape in ALLOWED.values())

    def unknown(m):
        rest = F.regexp_replace(m["match"], PLACEHOLDER, "")
        return ~m["match"].rlike(allowed) & (F.length(rest) >= WINDOW)

    wanted = F.filter(found(text, pattern), unknown)
    marked = F.transform(
        wanted, lambda m: F.struct(m["start"].alias("start"), high_windows(m["match"], least, alphabet).alias("w"))
    )
    return F.transform(
        F.filter(marked, lambda m: m["w"]["first"].isNotNull()),
        lambda m: _span(kind, m["start"] + m["w"]["first"], m["start"] + m["w"]["last"]),
    )


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row_id, spans)``: all spans ``(start, rank, kind, end)``, sorted by start and then by kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(
        found(whole, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_VALUE
    )
    parts = [_whole("assign", assigned), _whole("access", found(whole, ACCESS)), _whole("hex", found(whole, HEX))]
    parts += [_uneven(kind, whole) for kind in CLASSES]
    spans = F.sort_array(F.concat(*parts))
    # The generator computes the spans once, however often they are used later.
    return docs.select(F.col(row_id), F.explode(F.array(spans)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < F.lit(len(KINDS) - len(CLASSES)))


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
