"""Secret scan (DataFrame functions only): fixed patterns plus sliding-window entropy.

The fixed kinds ``assign``, ``access`` and ``hex`` are regular expressions. The method adds
``entropy_hex`` and ``entropy_b64``: candidate strings of a character class are cut out of
the text, a window slides over each, and the Shannon entropy of the window is kept up to date
by the counts of the character that enters and the one that leaves. Windows at or
above the class's threshold are merged to spans. Candidates on the allow list, spans that hold a
placeholder, and spans that a fixed kind already covers, are left out.

A match's place is the sum of the lengths before it: the text is split at the matches, so
gaps and matches alternate. All positions are in code points, ends exclusive. Lists of spans are
made in blocks, in time that grows with their number, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")
BASE_KINDS = 3
WINDOW = 20

SPAN = "struct<start:int,end:int,value:string>"
NAMED_SPAN = "struct<start:int,rank:int,kind:string,end:int>"
SPANS, NAMED = f"array<{SPAN}>", f"array<{NAMED_SPAN}>"


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    candidate: str
    alphabet: str
    #: Bits a character; windows at or above it count.
    threshold: float
    #: Patterns that a candidate must hold, each once at least.
    needs: tuple[str, ...]


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789ABCDEFabcdef", 3.0, ("[0-9]", "[A-Fa-f]")),
    CharacterClass(
        "entropy_b64",
        r"[A-Za-z0-9+/=_-]{20,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-",
        3.7,
        ("[0-9]", "[A-Z]", "[a-z]"),
    ),
)

#: Candidates that are one of these are no secrets: UUIDs, digests of nothing.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^e3b0c44298fc1c149afbf4c8996fb924",
    r"^da39a3ee5e6b4b0d3255bfef95601890afd80709$",
    r"^d41d8cd98f00b204e9800998ecf8427e$",
)
#: Spans that hold one of these are no secrets either: the alphabet and the digits in order, placeholders.
PLACEHOLDERS = (
    r"(?i)abcdefghij|0123456789|1234567890",
    r"(?i)example|placeholder|changeme|your[_-]",
)
#: Elements of a block of ``_scan``.
BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _step(state: Column, result: Column) -> Column:
    return F.struct(state.alias("s"), result.alias("r"))


def _scan(items: Column, start: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Runs ``step``, which makes ``_step(state, result)`` of state and item, over an array; the results.

    ``kind`` is the type of a result. Results are appended within blocks and blocks to each other, so
    that little is copied.
    """
    none, no_blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        return _let(step(acc["s"], x), lambda m: _step(m["s"], F.concat(acc["r"], F.array(m["r"].cast(kind)))))

    def append(acc: Column, block: Column) -> Column:
        return _let(F.aggregate(block, _step(acc["s"], none), one), lambda d: _step(d["s"], F.concat(acc["r"], F.array(d["r"]))))

    def whole(x: Column) -> Column:
        n = F.ceil(F.size(x) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * BLOCK + 1, BLOCK))
        found = F.aggregate(blocks, _step(start, no_blocks), append, lambda acc: F.flatten(acc["r"]))
        return F.when(F.size(x) > 0, found).otherwise(none)

    return _let(items, whole)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches of a pattern, leftmost and non-overlapping, with one group's text."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    # The gap after the last match has no match.
    zipped = F.filter(zipped, lambda x: x["found"].isNotNull())

    def step(at: Column, x: Column) -> Column:
        start = at + F.char_length(x["gap"])
        end = start + F.char_length(x["found"])
        value = F.regexp_extract(x["found"], pattern, group) if group else x["found"]
        return _step(end, F.struct(start.alias("start"), end.alias("end"), value.alias("value")))

    return F.when(text.rlike(pattern), _scan(zipped, F.lit(0), SPAN, step)).otherwise(F.array().cast(SPANS))


def _named(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    named = F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")
        ),
    )
    return named.cast(NAMED)


def _windows(value: Column, of: CharacterClass) -> Column:
    """Merged (start, end, text) of the windows of one candidate that reach the threshold."""
    # With the counts c of a window, its entropy is log2(w) - sum(c log2 c) / w.
    grown = F.array(*(F.lit((c + 1) * log2(c + 1) - (c * log2(c) if c else 0.0)) for c in range(WINDOW + 1)))
    limit = WINDOW * (log2(WINDOW) - of.threshold) + 1e-9
    other = lambda text, c: F.char_length(F.replace(text, c, F.lit("")))

    def whole(chars: Column) -> Column:
        def step(total: Column, end: Column) -> Column:
            """The sum of c log2 c over the window that ends at ``end``, from that of the one before."""
            new, old = F.get(chars, end - 1), F.coalesce(F.get(chars, end - WINDOW - 1), F.lit(""))
            size = F.least(end - 1, F.lit(WINDOW - 1))

            def change(both: Column) -> Column:
                """``both`` holds the characters of both windows."""
                lost = F.when(old == "", F.lit(0.0)).otherwise(F.get(grown, size - other(both, old)))
                return F.get(grown, size - other(both, new)) - lost

            both = F.array_join(F.slice(chars, F.greatest(end - WINDOW + 1, F.lit(1)), size), "")
            return _let(total + F.when(new == old, F.lit(0.0)).otherwise(_let(both, change)), lambda now: _step(now, now))

        def merged(hits: Column) -> Column:
            first = lambda x, i: F.coalesce(x - F.get(hits, i - 1) > WINDOW, F.lit(True))
            last = lambda x, i: F.coalesce(F.get(hits, i + 1) - x > WINDOW, F.lit(True))

            def span(a: Column, b: Column) -> Column:
                text = F.array_join(F.slice(chars, a - WINDOW + 1, b - a + WINDOW), "")
                return F.struct((a - WINDOW).alias("start"), b.alias("end"), text.alias("value"))

            return F.zip_with(F.filter(hits, first), F.filter(hits, last), span)

        totals = _scan(F.sequence(F.lit(1), F.size(chars)), F.lit(0.0), "double", step)
        ends = F.transform(totals, lambda x, i: F.when((i + 1 >= WINDOW) & (x <= limit), i + 1))
        return _let(F.filter(ends, lambda x: x.isNotNull()), merged)

    return _let(F.filter(F.split(value, ""), lambda x: x != ""), whole)


def _entropy_spans(text: Column, of: CharacterClass, allow: tuple[str, ...], placeholders: tuple[str, ...]) -> Column:
    found = _matches(text, of.candidate)
    for need in of.needs:
        found = F.filter(found, lambda x: x["value"].rlike(need))  # noqa: B023
    for pattern in allow:
        found = F.filter(found, lambda x: ~x["value"].rlike(pattern))  # noqa: B023
    placed = F.transform(
        found,
        lambda x: F.transform(
            _windows(x["value"], of),
            lambda y: F.struct(
                (y["start"] + x["start"]).alias("start"), (y["end"] + x["start"]).alias("end"), y["value"].alias("value")
            ),
        ),
    )
    spans = F.flatten(placed)
    for pattern in placeholders:
        spans = F.filter(spans, lambda x: ~x["value"].rlike(pattern))  # noqa: B023
    return spans


def _with_added(base: Column, added: Column) -> Column:
    """Sorted spans of both; added ones that lie within a base span are left out."""

    def step(reach: Column, x: Column) -> Column:
        """Base spans come first of those with one start, so the furthest end so far tells."""
        is_base = x["rank"] < F.lit(BASE_KINDS)
        kept = F.when(is_base | (x["end"] > reach), x)
        return _step(F.when(is_base, F.greatest(reach, x["end"])).otherwise(reach), kept)

    whole = F.filter(_scan(F.array_sort(F.concat(base, added)), F.lit(-1), NAMED_SPAN, step), lambda x: x.isNotNull())
    return F.when(F.size(added) > 0, whole).otherwise(base)


def find_secrets(
    docs: DataFrame, *, text: str = "text", allow: tuple[str, ...] = ALLOW, placeholders: tuple[str, ...] = PLACEHOLDERS
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, rank, kind, end), in order.

    A null text is empty and has no spans. Rows come back as often as they are given, an
    empty table gives an empty result. Columns of ``docs`` named ``base_spans`` or ``spans``
    are replaced; the text may be one of them.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    assign = F.filter(_matches(whole, ASSIGN, 2), lambda x: F.char_length(x["value"]) >= 6)
    base = F.array_sort(
        F.concat(_named(assign, "assign"), _named(_matches(whole, ACCESS), "access"), _named(_matches(whole, HEX), "hex"))
    )
    added = F.concat(*(_named(_entropy_spans(whole, x, allow, placeholders), x.kind) for x in CLASSES))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base_spans", "spans")]
    found = docs.select(*kept, base.alias("base_spans"), added.alias("spans"))
    return found.withColumn("spans", _with_added(F.col("base_spans"), F.col("spans")))


def spans_text(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``find_secrets`` in the text replaced by ``mark``.

    Overlapping spans are replaced by one mark. Texts without spans, null included, stay, and so do
    all other columns, whatever their names.
    """
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns if c != text)) if len(columns) > 1 else F.lit(0)
    found = find_secrets(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text")))

    def step(at: Column, x: Column) -> Column:
        kept = F.greatest(x["start"] - at, F.lit(0))
        return _step(F.greatest(at, x["end"]), F.struct(at.alias("at"), kept.alias("n"), (x["start"] >= at).alias("whole")))

    def cut(block: Column) -> Column:
        """The text between the spans of a block; each block looks into the text once."""
        begin = F.get(block, F.lit(0))["at"]
        size = F.array_max(F.transform(block, lambda x: x["at"] + x["n"])) - begin
        piece = lambda part, x: F.when(x["whole"], F.concat(F.substring(part, x["at"] - begin + 1, x["n"]), F.lit(mark))).otherwise("")
        return _let(F.substring(F.col("text"), begin + 1, size), lambda part: F.array_join(F.transform(block, lambda x: piece(part, x)), ""))

    def joined(gaps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / BLOCK).cast("int")), lambda i: F.slice(gaps, i * BLOCK + 1, BLOCK))
        return F.array_join(F.transform(blocks, lambda block: cut(block)), "")

    tail = F.substring(F.col("text"), F.array_max(F.transform("spans", lambda x: x["end"])) + 1, F.lit((1 << 31) - 1))
    clean = F.concat(_let(_scan(F.col("spans"), F.lit(0), "struct<at:int,n:int,whole:boolean>", step), joined), tail)
    done = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    return found.select(*(done.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns))
